"""The pipeline against a brute-force version of every stage, and the registered queries."""

import zlib
from collections import Counter

import numpy as np
from test_operators import WORDS, contamination, fingerprint, prose, words

import corpus_pipeline
from docloom.llm import mixing, quality
from docloom.llm.queries import QUERIES, SQL, vocabulary


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = [prose(i, 80 + 5 * i) for i in range(40)]
    texts[7], texts[9] = texts[3], texts[3].replace("river", "RIVER", 1)
    item = " ".join(texts[11].split()[10:60])
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(40, "too short", "en", "s0", 9), (41, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    # one stage after another, each by another way than the operator's
    kept = {r["doc_id"] for r in quality.rate(docs, vocabulary("piece_bpe_32k.model")).where("kept").collect()}
    assert kept >= set(range(40)) and not kept & {40, 41}
    fps = {i: fingerprint(texts[i]) for i in sorted(kept)}
    firsts, root = [], {}
    for i in fps:
        near = [root[j] for j in root if bin(fps[i] ^ fps[j]).count("1") <= 4]
        root[i] = min([*near, i])
        root = {k: root[i] if v in near else v for k, v in root.items()}
    firsts = sorted(set(root.values()))
    assert 7 not in firsts and 9 not in firsts
    bad = {k[0] for k in contamination([(i, texts[i]) for i in firsts], [(1, item)]) if k[4]}
    clean = [i for i in firsts if i not in bad]
    assert 11 in bad and len(clean) > 30
    plan = mixing.mix_plan(docs.where(docs["doc_id"].isin(clean))).collect()
    mixed = []
    for r in plan:
        left, cut = r["taken"], texts[r["doc_id"]]
        while left > 0:
            n = min(left, len(words(cut)))
            mixed.append((r["doc_id"], cut if n == len(words(cut)) else " ".join(cut.split(" ")[:n])))
            left -= n
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = [(i, tokenizer.encode(t, add_special_tokens=False).ids + [2]) for i, t in mixed]
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def test_registry():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(SQL) <= set(QUERIES) and len(corpus_pipeline.STAGES) == 5 and WORDS
