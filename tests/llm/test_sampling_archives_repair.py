"""Importance resampling, WARC archives and conversation repair against brute force, with nulls, ties, repeated rows and long texts."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest

from docloom.llm import convrepair, resample, warc

WORDS = "the of river Stone cloud GREEN été straße 日本語 x1 ab".split()


def prose(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", ", ", "\n", "-", "_"]) for _ in range(n))


# -- importance resampling


def folded(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def runs(text, n_gram=2):
    w = folded(text)
    return [" ".join(w[i : i + n]) for n in range(1, n_gram + 1) for i in range(len(w) - n + 1)]


def buckets(text, n_gram=2, n_buckets=10_000):
    return Counter(zlib.crc32(f.encode()) % n_buckets for f in runs(text, n_gram))


def brute_resample(docs, target):
    raw, aim = sum((buckets(t) for _, t in docs), Counter()), sum((buckets(t) for t in target), Counter())
    s, t = sum(raw.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log(((aim[b] + 1.0) * (s + 10_000.0)) / ((raw[b] + 1.0) * (t + 10_000.0))))
    out = []
    for i, text in docs:
        own = buckets(text)
        n = sum(own.values())
        weight = sum(gain(b) * k for b, k in own.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(folded(text))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def sample_rows():
    rows = [(i, prose(i, 5 + 6 * i)) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " ,.\n"), (63, "z" * 300 + " " + "ü" * 5000 + " a"), (64, prose(1, 9000)), rows[50], rows[50], (None, prose(3, 50)), (None, prose(3, 50)), (None, None)]
    return rows


def test_resampling(spark):
    rows, target = sample_rows(), [prose(77, 400), None, "", prose(5, 9)]
    docs = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "doc_id long, text string, key string, row long, bucket long").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(docs, aim).select("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(map(tuple, got.collect())) == Counter(brute_resample(rows, target))
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    drawn = resample.resampled_documents(docs, aim)
    want = Counter(r[0] for r in brute_resample(rows, target) if r[4] is not None)
    assert Counter(r["doc_id"] for r in drawn.collect()) == want and drawn.columns == docs.columns
    none = docs.limit(0)
    assert resample.resample(none, aim).count() == 0 and resample.resampled_documents(none, aim).count() == 0
    assert resample.resample(docs, aim.limit(0)).where("rank IS NOT NULL").count() == sum(want.values())


@pytest.mark.parametrize("n_gram", [1, 2, 3])
def test_byte_automaton_in_blocks(monkeypatch, n_gram):
    monkeypatch.setattr(resample, "WORDS_AT_ONCE", 7)
    monkeypatch.setattr(resample, "BYTES_AT_ONCE", 500)
    texts = [t for _, t in sample_rows()[:20]] + [None, "", "one", "é" * 70, "tail end"]
    column = pa.array(["skipped", *texts]).slice(1)
    got = [Counter() for _ in texts]
    for at, part in resample._slices(column):
        for rows, found in resample.features(part, n_gram, 1000):
            for r, b in zip(rows.tolist(), found.tolist()):
                got[at + r][b] += 1
    assert got == [buckets(t, n_gram, 1000) for t in texts]


# -- WARC


def payload_rows():
    rows = [(i, f"http://a.example/{i}?q=%20 x", f"<p>{'é' * (i % 7)} page {i % 11}</p>") for i in range(40)]
    return rows + [(50, None, None), (51, "http://b.example/", ""), (None, "u", rows[3][2]), (3, "http://other/", rows[3][2]), rows[3], (60, "line\r\nbreak", "long " * 5000), (61, "v", "long " * 5000), (62, "w", "last\r\n\r\nWARC/1.1\r\n")]


def brute_types(rows, least):
    of = {}
    for i, _, html in rows:
        of.setdefault(html or "", []).append(i)
    out = []
    for html, ids in of.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            raw = html.encode()
            again = k > 0 and len(raw) >= least
            out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", ids[0] if again else None))
    return Counter(out)


@pytest.mark.parametrize("level, least, size", [(3, 0, 1000), (0, 12, 7)])
def test_archives(spark, tmp_path, level, least, size):
    rows, store = payload_rows(), str(tmp_path / "store")
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, chunk string, record long").repartition(3)
    warc.write_archives(pages, store, min_bytes=least, level=level, chunk_bytes=size)
    got = warc.read_records(spark, store)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()) == brute_types(rows, least)
    whole = {}
    for r in sorted(warc.read_chunks(spark, store).collect(), key=lambda r: (r["record_id"], r["chunk_no"])):
        if r["record_type"] == "response":
            whole.setdefault((r["page_id"], r["record_id"]), []).append(bytes(r["chunk"] or b""))
    texts = Counter((k[0], b"".join(v).decode()) for k, v in whole.items())
    assert set(texts) <= {(i, h or "") for i, _, h in rows} and {t for _, t in texts} == {h or "" for _, _, h in rows}
    urls = {r["url"] for r in got.collect()}
    assert {u for _, u, _ in rows} == urls
    files = [Path(r["archive"].removeprefix("file://")) for r in spark.read.parquet(f"{store}/archives").collect()]
    raw = [gzip.decompress(f.read_bytes()) if level else f.read_bytes() for f in files]
    assert sum(x.count(b"WARC/1.1\r\nWARC-Type: ") for x in raw) == len(rows) and len(files) > 1
    # a byte of a payload that is not what it was, and an archive that ends too early, are found
    at = next(k for k, x in enumerate(raw) if b"long long" in x)
    big, data, sound = files[at], raw[at].replace(b"long long", b"lang long", 1), files[at].read_bytes()
    big.write_bytes(gzip.compress(data) if level else data)
    with pytest.raises(Exception, match="is not what its header says"):
        warc.read_records(spark, store).count()
    big.write_bytes(sound[:-2])
    with pytest.raises(Exception, match="ends within|does not end"):
        warc.read_records(spark, store).count()


def test_no_archives(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc.read_records(spark, str(tmp_path / "none")).count() == 0 and warc.read_chunks(spark, str(tmp_path / "none")).count() == 0


# -- conversation repair

BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def cheapest(marked):
    """(cost, audit, repaired) of rows (initial, fault, role, text): a table of whole strings from the end, by relaxing inserts until nothing changes."""
    wanted, after = {0: "user", 1: "user", 2: "assistant", 3: "user"}, {0: 2, 1: 2, 2: 3, 3: 2}
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, "", ()), 3: (0, "", ())}
    for k in range(len(marked), -1, -1):
        if k < len(marked):
            first, fault, role, text = marked[k]
            new = {}
            for q in range(4):
                ways = [(best[q][0] + 3, "D" + best[q][1], best[q][2])] if q in best else []
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    if (q, first) in kept and kept[q, first] in best:
                        c, a, r = best[kept[q, first]]
                        ways.append((c + more, "K" + a, (f"{role}:{text}", *r)))
                    if after[q] in best:
                        c, a, r = best[after[q]]
                        ways.append((c + more + 2, "R" + a, (f"{wanted[q]}:{text}", *r)))
                if ways:
                    new[q] = min(ways)
            best = new
        for _ in range(4):
            for q in range(4):
                if after[q] in best:
                    c, a, r = best[after[q]]
                    way = (c + 2, "I" + a, (f"{wanted[q]}:", *r))
                    best[q] = min(best.get(q, way), way)
    return best[0]


def brute_repair(rows):
    of = {c: [] for c, *_ in rows}
    for r in damaged(rows):
        of[r[0]].append(r)
    out = []
    for conv, own in of.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        seen, marked = set(), []
        for _, _, role, text in own:
            last = text.rstrip(BLANK)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            seen.add((role, text))
            marked.append((role[:1] if role[:1] in ("s", "u", "a") else "o", fault, role, text))
        turns = [t for _, t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        n = Counter(m[1] for m in marked)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, repaired = cheapest(marked)
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=repr)


def talk(seed, conv, n):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    return [(conv, rng.choice([k, k, k, k + 3, None]), rng.choices(roles, [1, 5, 5, 3, 3, 1, 0.3, 0.3])[0], rng.choice(["Yes.", "No!", "why?", "cut off", "  ", "", None, f"Line {k}.", f"Line {k}.", f"{k}"])) for k in range(n)]


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("block", [3, 256])
def test_conversation_repair(spark, monkeypatch, block):
    monkeypatch.setattr(convrepair, "BLOCK", block)
    rows = [r for k in range(60) for r in talk(k, k, k % 9 + 1)] + talk(99, 100, 90) + talk(98, None, 30) + [(101, 0, "user", "Hello there. " * 3000)]
    rows += [(102, 1, "user", "Same."), (102, 1, "user", "Same."), (103, None, None, None)]
    frame = spark.createDataFrame([(*r, "b", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, place long").repartition(4)
    got = convrepair.audit_conversations(frame, convrepair.damage(frame)).select(*REPORT)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_repair(rows)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"] * 2


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Ho"), (2, 5, "assistant", "Alone."), (3, 0, "user", " ")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    report, repaired = convrepair.repair(frame)
    assert {r["conv_id"]: (r["audit"], r["cost"]) for r in report.collect()} == {1: ("KDK", 4), 2: ("IK", 2), 3: ("D", 3)}
    got = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in repaired.orderBy("conv_id", "block", "step").collect()]
    assert got == [(1, 0, "user", "Hi."), (1, 2, "assistant", "Ho"), (2, None, "user", ""), (2, 5, "assistant", "Alone.")]
    assert convrepair.audit_conversations(frame.limit(0)).count() == 0


def test_solver_on_long_signatures():
    rng = random.Random(5)
    for _ in range(200):
        signature = "".join(rng.choice("suaoSUAOxyz_") for _ in range(rng.randrange(9)))
        fault = lambda x: "blank" if x in convrepair.GONE else "truncated" if x in convrepair.CUT else ""
        cost, audit, _ = cheapest([(convrepair.initial(x), fault(x), "", "") for x in signature])
        solver = convrepair.Solver(signature, None)
        assert (solver.cost(0, convrepair.START), solver.edits(convrepair.START)[0]) == (cost, audit)
    deep = convrepair.Solver("ua" * 3000, None)
    assert deep.cost(0, convrepair.START) == 0 and deep.edits(convrepair.START)[0] == "K" * 6000


def test_a_text_with_very_many_separate_spans(spark):
    from docloom.llm import decontam

    item = " ".join(f"w{i}" for i in range(13))
    n = 100_000
    docs = spark.createDataFrame([(1, f"{item} filler " * n), (2, f"{item} {item} x"), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", item), ("b", item)], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], len(r["spans"] or [])) for r in decontam.contamination(docs, bench).collect()}
    assert got == {1: (14 * n, 13 * n, 2, n), 2: (27, 26, 2, 1), 3: (1, 0, 0, 0)}
