"""Every operator on small tables with nulls, empty and long texts, ties, repeated rows, clashing names; and against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import components, decontam, htmltext, langid, mixing, quality, simhash, substrings, tokencount, tokenstore, urlfilter
from docloom.llm.queries import vocabulary

WORDS = "the of and to in is that river stone cloud green winter market letter garden window silver morning paper yellow forest".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, row long, fp long, bucket string, _doc string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ly", "."]) for _ in range(n))


def rows():
    texts = [prose(i, 60 + 7 * i) for i in range(24)]
    texts[5] = texts[3]  # an exact copy
    texts[6] = texts[3].replace("river", "RIVER", 1)
    texts[7] = prose(900, 4000)  # a long one
    texts[8] = texts[7][:2000] + " and then some other ending"
    texts[9] = "Once upon  a time\n\n\tthere was"
    texts[10] = "a b c"
    texts[11] = "spam! " * 80
    out = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}", len(t), 1, "k", 2, 3, "b", "d") for i, t in enumerate(texts)]
    out += [(24, None, None, None, None, None, None, None, None, None, None), (25, "", "en", "s0", 0, 1, "k", 2, 3, "b", "d"), (26, " \n\t ", "de", None, 4, 1, "k", 2, 3, "b", "d")]
    return out + [out[2], (None, texts[4], "en", "s1", 9, 1, "k", 2, 3, "b", "d")]  # a repeated row, and one without an id


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mixing(docs, empty):
    found = mixing.mix_plan(docs).collect()
    assert len(found) == len(rows())
    total = sum(len(words(r[1])) for r in rows())
    by = {}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    assert sum(r["size"] for r in found) == total
    targets = {s: v[0]["target"] for s, v in by.items()}
    assert sum(targets.values()) == pytest.approx(total)
    for s, v in by.items():
        assert targets[s] <= 3 * v[0]["source_size"] and v[0]["source_size"] == sum(r["size"] for r in v)
        assert abs(sum(r["taken"] for r in v) - targets[s]) <= 2
    weights = dict(zip(sorted(s for s in by if s is not None) + [None], [5, 2, 1, 5, 2]))
    level = max(t / weights[s] for s, t in targets.items())
    assert all(t == pytest.approx(min(3 * by[s][0]["source_size"], level * weights[s])) for s, t in targets.items())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r["source"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"]) or r["doc_id"] is None
    assert got == Counter({s: n for s in by if (n := sum(r["taken"] for r in by[s]))})
    assert sorted(map(tuple, mixing.mix_plan(docs).fillna(-1).collect()), key=repr) == sorted(map(tuple, mixing.mix_plan(docs.repartition(1)).fillna(-1).collect()), key=repr)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mixing_fills_up_tied_rows(spark):
    rows = [(None, "a", "w") for _ in range(90)] + [(None, "a", "w " * 1000) for _ in range(10)] + [(k, "b", "w " * 100) for k in range(300)] + [(7, None, "w " * 50)] * 3
    got = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    for source in ("a", "b", None):
        own = [r for r in got if r["source"] == source]
        assert -0.5 <= own[0]["target"] - sum(r["taken"] for r in own) < len(own)
        assert all(r["taken"] <= 3 * r["size"] for r in own)


def test_token_store(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    store = str(tmp_path / "store")
    tokenstore.write_store(docs, store, path)
    assert len(tokenstore.check_manifest(spark, store)) == 64
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for r in rows():
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    found = tokenstore.read_checksums(spark, store).orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    start = 0
    for r in found:
        assert r["start"] == start
        start += r["n_tokens"]
    whole = tokenstore.read_ids(spark, store).collect()
    for r in whole:
        assert len(np.frombuffer(r["ids"], "<u2")) == r["n_tokens"]
    assert tokenstore.chunks_of(spark, store).count() == tokenstore.chunks_of(spark, store).select("key").distinct().count()
    tokenstore.write_store(empty, str(tmp_path / "none"), path)
    assert tokenstore.read_checksums(spark, str(tmp_path / "none")).count() == 0


def test_token_store_notices_damage(spark, docs, tmp_path):
    store = str(tmp_path / "store")
    tokenstore.write_store(docs, store, vocabulary("byte_bpe_50k.json"))
    bad = tokenstore.recipes_of(spark, store).withColumn("start", F.col("start") + F.when(F.col("place") == 3, 1).otherwise(0))
    bad.write.parquet(str(tmp_path / "bad" / "recipes"))
    spark.read.parquet(f"{store}/manifest").write.parquet(str(tmp_path / "bad" / "manifest"))
    with pytest.raises(ValueError):
        tokenstore.check_manifest(spark, str(tmp_path / "bad"))


def test_encoder_pieces():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["", "  ", " a", "a ", "a  b", "a \n b", "\n\nx", "x\n", "it's  don't 's ' s", "tab\tx y\t", "é x y  z", "a\x1cb \x1c c", "<|endoftext|> hi", "a <|endoftext|>b c <|endoftext|>", "日本 語  字", "a　b", " \t", "1 2,3. 4\r\n5", "ĉ x", "a\x00b", "a\n'b c\n 'd", "\nx", "x\n", "a\n日本 b", "϶a ϵb", "don' 's a's _x_ __ x\n__", "w" * 39 + " " + "w" * 50 + " é" * 20, "ÄÖ straße's\n-x-", "привет, мир!\nда"]
    rng = random.Random(8)
    odd += ["".join(rng.choice(["a", "b", "é", "日", "1", "'", "s", ".", "%", " ", " ", "\n", "\t", "the", "Ж", "<|endoftext|>"]) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    got = list(tokenstore.Encoder(path).encode(pa.array([*odd, None])))
    assert [g.tolist() for g in got] == [tokenizer.encode(x, add_special_tokens=False).ids for x in [*odd, ""]]


def test_store_of_a_large_vocabulary(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenstore, "width_of", lambda path: 4)
    path, store = vocabulary("byte_bpe_50k.json"), str(tmp_path / "wide")
    pack = tokenstore._checked(4)
    assert tokenstore.width_of(path) == 4 and pack is not None
    raw = np.array([70_000, 2], "<u4").tobytes()
    chunk = pa.RecordBatch.from_arrays([pa.array([tokenstore.digest(raw)], pa.binary()), pa.array([2], pa.int64()), pa.array([raw], pa.binary())], names=["key", "n_ids", "ids"])
    assert [b.column("crc").to_pylist() for b in pack(iter([chunk]))] == [[zlib.crc32(raw)]]
    spark.createDataFrame([(4, 2)], "width long, end_id long").write.parquet(f"{store}/layout")
    assert tokenstore.layout_of(spark, store) == (4, 2)


def contamination(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = Counter()
    for doc_id, text in docs:
        w, hit, names = cut(text), set(), set()
        for item, item_text in items:
            v = cut(item_text)
            n = min(13, len(v))
            for window in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else ():
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) == window:
                        hit.update(range(i, i + n))
                        names.add(str(item))
        out[doc_id, len(w), len(hit), tuple(sorted(names)), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    return out


@pytest.mark.parametrize("bound", [200_000, 0])
def test_decontamination(spark, docs, empty, monkeypatch, bound):
    monkeypatch.setattr(decontam, "BROADCAST_HASHES", bound)
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", bound)
    text = {r[0]: r[1] for r in rows()}
    items = [(1, " ".join(text[3].split()[20:50]).upper()), (2, "a, b; c"), (30, " ".join(text[7].split()[5:18])), (4, None), (5, ""), (6, "Once upon a time there"), (30, "a b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(docs, bench).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in found)
    assert got == contamination([(r[0], r[1]) for r in rows()], items)
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(k[0] for k, n in got.items() for _ in range(n) if not k[4])
    spans = {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs, bench, unit="span").collect()}
    assert spans[0] == text[0] and spans[24] is None
    left = len(re.findall(r"[A-Za-z0-9]+", spans[3]))
    assert left == len(re.findall(r"[A-Za-z0-9]+", text[3])) - 30
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_by_many_windows(spark, docs):
    text = {r[0]: r[1] for r in rows()}
    rng = random.Random(9)
    items = [(k, " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(400))) for k in range(12)] + [(999, text[8])]  # some thousand windows
    found = decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in found) == contamination([(r[0], r[1]) for r in rows()], items)


def test_url_filter(spark):
    urls = ["http://www.Example.NET/en/x?q#f", "https://a.net", "http://net/", "http://xnet/a", "https://b.example.com/de/1", "https://org/fr/", "https://a.b.org/fr", "no url", None, "x://", "http://example.net.evil/en/", "http://a.example.net/de/"]
    table = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(table, urlfilter.rule_table(spark), "page_id").collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        assert got[i] == (host, path, best and best.host + best.path, best.verdict if best else "allow")
    kept = urlfilter.filter_urls(table.unionByName(spark.createDataFrame([(1, "http://org/fr/", "y")], table.schema)), urlfilter.rule_table(spark))
    assert kept.columns == table.columns
    assert Counter(r["url"] for r in kept.collect()) == Counter([u for i, u in enumerate(urls) if got[i][3] == "allow"] + [u for u in urls[:1] if got[0][3] == "allow"] + ["http://org/fr/"])
    assert urlfilter.judge_urls(table.limit(0), urlfilter.rule_table(spark), "page_id").count() == 0
    assert urlfilter.judge_urls(table, urlfilter.rule_table(spark).limit(0), "page_id").where("verdict <> 'allow'").count() == 0


def test_url_sweep_against_all_rules():
    rng = random.Random(3)
    label = lambda: rng.choice(["a", "b", "c"])
    key = lambda h: "".join(x + urlfilter.END for x in reversed(h.split("."))) if h else ""
    for _ in range(200):
        rules = sorted({(key(h), rng.choice(["allow", "block"]), h, p) for h, p in ((".".join(label() for _ in range(rng.randint(1, 3))), "/" + label() * rng.randint(0, 2)) for _ in range(6))})
        urls = sorted((key(h), h, p) for h, p in ((".".join(label() for _ in range(rng.randint(1, 4))), "/" + label() * rng.randint(0, 3)) for _ in range(20)))
        got = urlfilter._sweep([u[0] for u in urls], [u[1] for u in urls], [u[2] for u in urls], urlfilter._hosts(rules))
        for (_, host, path), won in zip(urls, got):
            fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for _, v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
            assert won == (max(fits)[3:] if fits else None)


def test_url_filter_of_a_host_with_many_rules(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "URLS_A_RANGE", 500)
    rules = [urlfilter.Rule("block" if k % 3 else "allow", "big.example.org", f"/{k}/") for k in range(100_000)] + [urlfilter.Rule("block", "example.org", "/77")]
    urls = [(k, f"http://{'sub.' * (k % 2)}big.example.org/{k * 37}/x") for k in range(2_000)] + [(5_000, "http://example.org/77"), (5_001, "http://other.org/77/")]
    got = {r["page_id"]: r["rule"] for r in urlfilter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), urlfilter.rule_table(spark, rules), "page_id").collect()}
    assert got == {k: f"big.example.org/{k * 37}/" for k in range(2_000)} | {5_000: "example.org/77", 5_001: None}


def test_token_counts(docs, empty):
    model = tokencount.Unigram(vocabulary("piece_bpe_32k.model"))

    def best(word):
        word = tokencount.MARK + word
        scores = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(scores[end - 1][0] + n * model.byte, -(-scores[end - 1][1] + n))]
            options += [(scores[a][0] + model.scores[word[a:end]], scores[a][1] - 1) for a in range(end) if word[a:end] in model.scores]
            scores.append(max(options))
        return -scores[-1][1], scores[-1][0]

    got = Counter((r["doc_id"], r["n_pretokens"], r["n_tokens"]) for r in tokencount.token_counts(docs, vocabulary("piece_bpe_32k.model")).collect())
    assert got == Counter((r[0], len(words(r[1])), sum(best(w)[0] for w in words(r[1]))) for r in rows())
    odd = sorted(tokencount.MARK + w for w in ["日本語", "naïve", "a", "aa", "aab", "\U0001f600x"])
    assert [n for n, _ in model.count(odd)] == [best(w[1:])[0] for w in odd]
    assert tokencount.token_counts(empty, vocabulary("piece_bpe_32k.model")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/a>A</a></li></ul></nav>
<div class="ad">Buy</div><article><h1>Head&amp;line</h1><p>First <b>bold</b>   text<br>and more<p>Second &eacute;<script>var x="<p>no</p>"</script></p></article>
<aside>side</aside><form>f</form><div id="comments"><article><p>reader</p></article></div><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    plain = lambda a, b: f"<html><body><div>Welcome to the site</div><div>{a}</div><div>{b}</div><div>All rights reserved</div></body></html>"
    pages = [(1, "http://h/a", PAGE, 1), (2, "http://x/p/1", plain("one", "two"), 1), (3, "http://x/p/2", plain("three", "four"), 1), (4, "http://y/", plain("alone", "here"), 1), (5, None, None, 1), (6, "http://h/b", "", 1), (7, "z", "just <i>text", 1), (1, "http://h/a", PAGE, 1), (8, "http://h/c", "<p>" + "w " * 60_000, 1)]
    got = {r["page_id"]: r for r in htmltext.main_text(spark.createDataFrame(pages, "page_id long, url string, html string, row int")).collect()}
    assert got[1]["text"] == "Head&line\n\nFirst bold text and more\n\nSecond é"
    assert got[2]["text"] == "one\n\ntwo" and got[3]["text"] == "three\n\nfour"
    assert got[4]["text"] == "Welcome to the site\n\nalone\n\nhere\n\nAll rights reserved"
    assert got[5]["text"] == "" and got[6]["text"] == "" and got[7]["text"] == "just text"
    assert got[8]["n_chars"] == 119_999
    assert htmltext.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_words_never_hide_the_whole_page():
    for page in (
        '<body class="has-sidebar"><nav>n</nav><article><p>text</p></article></body>',
        '<div class="content-sidebar-wrap"><article><p>text</p></article><div class="sidebar">s</div></div>',
        '<div class="ad">a</div><article class="post share"><p>text</p><div class="share">s</div></article>',
    ):
        assert [x.text for x in htmltext.lines_of(page) if x.inside and x.mark == htmltext.PLAIN] == ["text"]
    assert [(x.text, x.mark) for x in htmltext.lines_of('<nav>n</nav><div class="sidebar-wrap"><p>text</p></div>')] == [("n", htmltext.SURE), ("text", htmltext.CALLED)]
    wrapped = '<form><article class="post comments-open"><p>text</p><div class="no-comments">more</div></article><div id="comments"><p>c</p></div></form>'
    assert [x.text for x in htmltext.lines_of(wrapped) if x.mark == htmltext.PLAIN] == ["text", "more"]


def test_html_neighbours_decide_on_unnamed_slots():
    page = lambda k: htmltext.lines_of(f"<nav>{k}</nav><div class='x1'>Buy {k}</div><article><p>Text {k} of the page</p></article><div>Own {k}</div><p class='x2'>{k}</p>")
    mine, other = page(1), page(2)[:3]
    parts = lambda p: ([htmltext._hash(x.text) for x in p], [htmltext._hash(x.slot) for x in p])
    marks, sizes = [x.mark + 4 * x.inside for x in mine], [len(x.text) for x in mine]
    alone, articles, met = htmltext.kept_lines(*parts(mine), marks, sizes, [])
    assert alone == [1, 2, 3, 4] and articles and not met and htmltext.worded(alone, marks, articles, met) == [2]
    kept, articles, met = htmltext.kept_lines(*parts(mine), marks, sizes, [parts(other)])
    assert kept == htmltext.worded(kept, marks, articles, met) == [2, 3, 4] and met  # the slot of x1 is the site's


def site_pages():
    """Pages with and without articles, mirrors, teasers, unlike menus, class words inside and outside of articles, repeated rows."""
    body = lambda menu, rest: f"<html><body><nav>{menu}</nav><div>Welcome to the site</div>{rest}<div class='ad'>Buy {menu}</div><div>All rights reserved</div><footer>{menu} &copy;</footer></body></html>"
    story = [f"<article><h1>Head {k}</h1><p>{prose(k, 30)}</p><p class='related-work'>Others did {k}.</p><section id='search'>How to look for {k}</section><div class='user-comments'>I like {k}</div><section id='comments'><p>Me too {k}</p></section><p class='notice'>Notice {k}</p><div role='alert'>Alert {k}</div>{f'<div class=social>Social life {k}.</div>' if k % 2 else ''}</article>" for k in range(6)]
    plain = [f"<div>{prose(100 + k, 20)}</div><div>{prose(200 + k, 9)}</div>" for k in range(4)]
    teased = [f"<div>{prose(300 + k, 80)}</div><article class='card'><p>Read {k}</p></article>" for k in range(3)]
    quoted = "<article><p>The same passage is quoted here.</p><p>And mine follows.</p></article>"
    rest = [*story[:4], *plain, *teased, quoted, quoted.replace("mine", "yours")]
    pages = [(f"http://site/{'abc'[k % 3]}/{k}", body(f"menu {k}", x)) for k, x in enumerate(rest)]
    pages += [("http://site/a/mirror", body("menu 4", plain[0])), ("http://two/1", body("m", plain[1])), ("http://two/2", body("m", plain[1])), ("http://two/2", body("m", plain[1]))]
    pages += [("http://one/", body("m", story[0])), ("http://site/b/none", None), ("http://site/b/blank", " "), (None, "<p>no url</p>"), ("http://site/z/1", body("m", story[4])), ("http://site/z/2", body("n", story[5].replace("<section id", "<section class=own id")))]
    return [(k, u, h) for k, (u, h) in enumerate(pages)]


def common_subsequence(a, b):
    """The plain table of longest common subsequences of what is left of a and b."""
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            n[i][j] = n[i + 1][j + 1] + 1 if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
    return n


def in_common(a, b):
    """Indexes of a in one longest common subsequence."""
    n, i, j, out = common_subsequence(a, b), 0, 0, []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        elif n[i + 1][j] >= n[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


class Cutter(HTMLParser):
    """Blocks of a well-formed page by the standard library's parser: (text, what, in an article, slot); nothing of the operator's."""

    def __init__(self, page):
        super().__init__()
        self.blocks, self.stack, self.held = [], [], ""
        self.feed(page or "")
        self.cut()

    def cut(self):
        text = " ".join(self.held.split())
        self.held = ""
        if text:
            kinds = [kind for _, kind, _ in self.stack]
            what = next((k for k in ("element", "named", "called") if k in kinds), "plain")
            self.blocks.append((text, what, any(n in ("article", "main") for n, _, _ in self.stack), "/".join(slot for _, _, slot in self.stack)))

    def handle_starttag(self, name, attrs):
        if name in ("b", "i", "br"):
            self.held += " " if name == "br" else ""
            return
        self.cut()
        given = dict(attrs)
        words, inside = (given.get("class") or "").split(), any(n in ("article", "main") for n, _, _ in self.stack)
        kind = "plain"
        if name in ("nav", "footer", "aside", "form") or name == "header" and not inside or given.get("role") in ("alert", "navigation"):
            kind = "element"
        elif name in ("div", "section") and any("comment" in w for w in (*words, given.get("id") or "")) or "comment" in (given.get("id") or ""):
            kind = "element"
        elif any(w in ("ad", "notice") for w in words):
            kind = "named"
        elif any(w in ("social", "newsletter", "share-toolbar", "promo") for w in words):
            kind = "called"
        self.stack.append((name, kind, ".".join([name, *sorted(words)])))

    def handle_endtag(self, name):
        if name not in ("b", "i"):
            self.cut()
            self.stack.pop()

    def handle_data(self, data):
        self.held += data


def runs(slots):
    return [i for i in range(len(slots)) if not i or slots[i] != slots[i - 1]]


def brute_text(pages, page):
    """The main text by the rules as told, over all pages of the host."""
    _, url, source = page
    split = lambda u: (u.split("://", 1)[1].split("/", 1)[0], "/" + u.split("://", 1)[1].split("/", 1)[1]) if u else ("", "")
    host, _ = split(url)
    first = {}
    for _, u, h in pages:
        if split(u)[0] == host:
            look = tuple(Cutter(h).blocks)
            first[look] = min(first.get(look, "\uffff"), split(u)[1])
    mine = tuple(Cutter(source).blocks)
    ranked = sorted((p, look) for look, p in first.items())
    at = next(i for i, (_, look) in enumerate(ranked) if look == mine)
    near = [ranked[i] for i in (at - 1, at + 1) if 0 <= i < len(ranked)]
    alike = lambda p: next((i for i, (x, y) in enumerate(zip(p, ranked[at][0])) if x != y), min(len(p), len(ranked[at][0])))
    near.sort(key=lambda x: -alike(x[0]))
    plain = [i for i, x in enumerate(mine) if x[1] == "plain"]
    shared, places, met = set(), set(), False
    for _, other in near:
        same = set(in_common([x[0] for x in mine], [x[0] for x in other]))
        if not plain or not same.issuperset(plain):
            a, b = runs([x[3] for x in mine]), runs([x[3] for x in other])
            of_runs = in_common([mine[i][3] for i in a], [other[i][3] for i in b])
            ends = [*a[1:], len(mine)]
            shared, places, met = same, {i for k in of_runs for i in range(a[k], ends[k])}, True
            break
    size = lambda some: sum(len(mine[i][0]) for i in some)
    inside = [i for i in plain if mine[i][2]]
    article = bool(inside) and size(i for i in plain if not mine[i][2] and i not in shared) <= 3 * size(inside)
    out = []
    for i, (text, what, within, _) in enumerate(mine):
        if what in ("element", "named") or within and inside and not article:
            continue
        if what == "called" and (not within or i in shared or i in places):
            continue
        if not within and (i in shared or article and (i in places or not met)):
            continue
        out.append(text)
    return "\n\n".join(out)


@pytest.mark.parametrize("a_range", [5000, 2])
def test_html_against_brute_force(spark, monkeypatch, a_range):
    monkeypatch.setattr(htmltext, "PAGES_A_RANGE", a_range)
    pages = site_pages()
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {p[0]: brute_text(pages, p) for p in pages}
    # what the rules come to: stories whole, with their own class words, but without the readers' comments
    assert got[22] == f"Head 5\n\n{prose(5, 30)}\n\nOthers did 5.\n\nHow to look for 5\n\nSocial life 5."  # the page beside it has no such passage
    assert got[0] == f"Head 0\n\n{prose(0, 30)}\n\nOthers did 0.\n\nHow to look for 0"
    assert got[4] == got[13] == f"{prose(100, 20)}\n\n{prose(200, 9)}"  # a mirror deletes nothing
    assert got[8] == prose(300, 80)  # and not its teaser
    assert got[11].startswith("The same passage") and got[12].endswith("And yours follows.")
    assert got[14] == got[15] == got[16] == f"Welcome to the site\n\n{prose(101, 20)}\n\n{prose(201, 9)}\n\nAll rights reserved"
    assert got[17].startswith("Head 0")


def test_html_long_alignments_are_split(monkeypatch):
    rng = random.Random(6)
    for size in (40, 300):
        a, b = ([rng.randint(0, 9) for _ in range(size)] for _ in "ab")
        whole = len(htmltext.shared_lines(a, b))
        monkeypatch.setattr(htmltext, "BITS_AT_ONCE", 64)
        kept = htmltext.shared_lines(a, b)
        monkeypatch.undo()
        assert len(kept) == whole == common_subsequence(a, b)[0][0] and kept == sorted(set(kept))
    page = "<div>a</div>" * 30_000 + "<p>b</p>"
    assert len(htmltext.lines_of(page)) == 30_001


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        kept = htmltext.shared_lines(a, b)
        assert len(kept) == table[-1][-1] and len(set(kept)) == len(kept)
        at = 0
        for x in (a[i] for i in kept):  # still a subsequence of b
            at = b.index(x, at) + 1


def fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    ids = [r[0] for r in rows()]
    fps = [fingerprint(r[1]) for r in rows()]
    up = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                old, new = up[i], up[j]
                up = [new if x == old else x for x in up]
    least = {u: min((ids[i] for i in range(len(ids)) if up[i] == u and ids[i] is not None), default=None) for u in set(up)}
    got = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_copies(docs).collect())
    assert got == Counter((ids[i], fps[i], least[up[i]]) for i in range(len(ids)))
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(least.values(), key=repr)
    assert simhash.near_copies(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0


@pytest.mark.parametrize("tile", [2048, 4])
def test_simhash_search_is_complete(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "SHIFTS", 3)
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64) << np.uint64(1)
    values = set(centres.tolist())
    for c in centres[:20].tolist():  # groups of fingerprints near each other
        for _ in range(20):
            x = c
            for b in rng.integers(0, 64, rng.integers(1, 6)).tolist():
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    raw = np.array(values, np.uint64)
    signed = raw.view(np.int64).tolist()
    up = list(range(len(values)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(raw[i] ^ raw[:i]) <= 4).tolist():
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    want = {}
    for i in range(len(values)):
        want.setdefault(root(i), set()).add(signed[i])
    got = {}
    for r in simhash.groups_of(spark.createDataFrame([(v,) for v in signed], "fp long")).collect():
        got.setdefault(r["root"], set()).add(r["fp"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_similar_texts_of_the_stage(spark, docs, empty, monkeypatch):
    import corpus_pipeline
    from docloom.llm import similar

    rng = random.Random(3)
    texts = [r[1] for r in rows()]
    for i in range(12):  # copies with some words changed, about the bound on both sides
        base = [f"w{rng.randint(0, 5000)}" for _ in range(200 + 20 * i)]
        texts.append(" ".join(base))
        for changes in (1, 3, 4, 5, 6, 9):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changes * len(copy) // 200):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    texts += [prose(50, 300) + " tail " + prose(k, 20) for k in range(12)]

    def shingled(text):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, up = [shingled(t) for t in texts], list(range(len(texts)))
    loose = 0
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                loose += bin(fingerprint(texts[i]) ^ fingerprint(texts[j])).count("1") > 4
                old, new = up[i], up[j]
                up = [new if x == old else x for x in up]
    assert loose  # near copies that four bits would not find
    least = sorted(min(i for i in range(len(up)) if up[i] == u) for u in set(up))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for pairs_a_row, sample in ((4, 20_000), (0, 20)):
        monkeypatch.setattr(similar, "PAIRS_A_ROW", pairs_a_row)
        monkeypatch.setattr(similar, "SAMPLE", sample)
        assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, table, "").collect()) == least
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL").count() == 0
    assert simhash.drop_near_copies(empty).count() == 0


def test_a_large_group_costs_its_members_not_its_pairs(spark, monkeypatch):
    from docloom.llm import similar

    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base)]
    for i in range(300):  # up to three words changed are near copies of the base, but not of each other; with more they are of nothing
        copy = list(base)
        for j, at in enumerate(rng.sample(range(150), rng.randint(1, 6))):
            copy[at] = f"c{i}x{j}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    sets, up = [{tuple(t.split()[i : i + 5]) for i in range(146)} for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if up[i] != up[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = up[i], up[j]
                up = [new if x == old else x for x in up]
    least = sorted(min(i for i in range(len(up)) if up[i] == u) for u in set(up))
    assert 50 < len(least) < 250
    compared, plain = [], similar._similar
    monkeypatch.setattr(similar, "_similar", lambda pairs, *others: compared.append(pairs.count()) or plain(pairs, *others))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(table).collect()) == least
    assert sum(compared) <= 4 * len(texts), compared


def test_passages_that_many_texts_share_cost_no_pairs(spark, monkeypatch):
    from docloom.llm import similar

    rng = random.Random(8)
    passages = [" ".join(f"p{k}x{i}" for i in range(60)) for k in range(2)]
    texts = [" ".join(f"w{k}x{i}" for i in range(50 + k % 7)) + " " + passages[k % 2] for k in range(120)]
    texts += [t.rsplit(" ", n)[0] for t in texts[:30] for n in (2, 9)]  # near copies that lose a part of the passage
    texts += [p + f" own{k} words{k}" for p in passages for k in range(15)]  # hardly more than the passage: similar to each other
    for t in texts[30:60]:  # about the bound, on both sides
        copy = t.split()
        for at in rng.sample(range(len(copy)), rng.randint(1, 4)):
            copy[at] = "changed"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    sets, up = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if up[i] != up[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = up[i], up[j]
                up = [new if x == old else x for x in up]
    least = sorted(min(i for i in range(len(up)) if up[i] == u) for u in set(up))
    assert 122 <= len(least) < len(texts) - 60
    compared, plain = [], similar._similar
    monkeypatch.setattr(similar, "COMMON", 1)  # as with many texts, the sample's list does not reach to the passages
    monkeypatch.setattr(similar, "_similar", lambda pairs, *others: compared.append(pairs.count()) or plain(pairs, *others))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(table).collect()) == least
    assert sum(compared) <= 4 * len(texts), compared


def test_texts_meet_at_the_first_shingle_they_share(spark):
    from docloom.llm import similar

    rng = random.Random(9)
    texts = [list(range(40)) for _ in range(6)] + [sorted(rng.sample(range(100, 190), rng.randint(20, 60))) for _ in range(60)]
    index = [(h, row, 110, pos, row) for row, text in enumerate(texts) for pos, h in enumerate(text)]
    under: dict = {}
    for h, row, size, pos, _ in index:
        under.setdefault(h, []).append((row, size - pos))
    expected = {(a, b) for held in under.values() for a, x in held for b, y in held if a < b and 9 * min(x, y) >= 4 * 220}
    met = [(r["a"], r["b"]) for r in similar._meeting(spark.createDataFrame(index, "h long, row long, size long, pos int, root long")).collect()]
    assert set(met) == expected and len(met) < 1.5 * len(expected)
    assert sum(b < 6 for _, b in met) == 15  # copies that share all meet once


def test_thresholds_are_the_cheapest():
    costs = [[0, 5, 9, 30, 99, 99], [0, 2, 8, 40, 99, 99], [0, 7, 11, 12, 99, 99]]
    cost, chosen = simhash.allocate(costs, 2)
    assert sum(chosen) == 2 and cost == min(costs[0][a + 1] + costs[1][b + 1] + costs[2][2 - a - b + 1] for a in range(-1, 5) for b in range(-1, 5) if -1 <= 2 - a - b <= 4)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (9, 3), (5, 6), (6, 5), (7, 7)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components.components(links).collect()} == {(2, 1), (3, 1), (9, 1), (6, 5)}


def base_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_quality(docs, empty):
    model = vocabulary("piece_bpe_32k.model")
    found = quality.rate(docs, model).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found)
    want = Counter()
    for r in rows():
        c = base_counts(r[1])
        want[(r[0], *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == want
    kept = {r["doc_id"] for r in found if r["kept"]}
    assert 11 not in kept and 24 not in kept and {0, 1, 2, 4} <= kept
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    for r in found:
        text = next(x[1] for x in rows() if x[0] == r["doc_id"])
        ids = [i for w in words(text) for i in pieces.encode(w)]
        assert r["n_tokens"] == len(ids)
        if ids:
            share = np.array(list(Counter(ids).values())) / len(ids)
            assert r["entropy"] == pytest.approx(-(share * np.log2(share)).sum())
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.rate(empty, model).count() == 0


def cut(docs):
    out = Counter()
    for i, text in docs:
        raw = (text or "").encode()
        seen = {t.encode()[p : p + 50] for j, t in docs if t is not None and None not in (i, j) and j < i for p in range(len(t.encode()) - 49)}
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if raw[p : p + 50] in seen:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out[i, len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("common, at_once", [(20_000, 4_000_000), (2, 4_000_000), (20_000, 7)])
def test_substrings(docs, empty, monkeypatch, common, at_once):
    monkeypatch.setattr(substrings, "COMMON", common)
    monkeypatch.setattr(substrings, "WINDOWS_AT_ONCE", at_once)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 50_000)
    got = Counter(tuple(r)[:5] for r in substrings.cut_repeats(docs).collect())
    assert got == cut([(r[0], r[1]) for r in rows()])
    if common == 2:
        assert substrings.cut_repeats(empty).count() == 0


def test_common_seeds_are_found_however_they_are_spread():
    shared = prose(1, 40)
    tasks = [[(i, 0, f"{prose(1000 + i, 3 * i + 10)} {shared}") for i in range(20 * t, 20 * t + 20)] for t in range(30)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["doc_id", "tag", "text"]) for rows in tasks]
    counts = Counter()
    for rows in tasks:
        for _, _, text in rows:
            counts.update(substrings.stretches(np.frombuffer(text.encode(), np.uint8))[2].view(np.int64).tolist())
    total, bound = sum(len(t.encode()) for rows in tasks for _, _, t in rows), 200
    found = Counter()
    for batch in batches:  # each holds every shared seed but a few times
        for out in substrings._frequent(bound, total)(iter([batch])):
            found.update(dict(zip(out.column("seed").to_pylist(), out.column("n").to_pylist())))
    common = {s for s, n in found.items() if n > bound}
    assert {s for s, n in counts.items() if n > 2 * bound} <= common <= {s for s, n in counts.items() if n > bound}
    assert common


def test_language_network_gradients():
    net = langid.Network(["a", "b"], seed=1)
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, (3, langid.SEGMENT)).astype(np.uint8)
    mask = np.ones((3, langid.SEGMENT), np.float32)
    mask[1, 10:] = 0
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    target = np.array([0, 1, 1])
    _, grads = net.gradients(data, mask, target)
    for name in ("uf", "ub", "cf", "vb", "o"):
        flat = net.weights[name].reshape(-1)
        at = int(np.abs(grads[name]).reshape(-1).argmax())
        step, old, losses = 1e-3, flat[at], []
        for d in (step, -step):
            flat[at] = old + d
            losses.append(net.gradients(data, mask, target)[0])
        flat[at] = old
        assert grads[name].reshape(-1)[at] == pytest.approx((losses[0] - losses[1]) / (2 * step), rel=0.1, abs=2e-4)


def test_language_id(spark, empty):
    fr = "le la des une avec pour être maison forêt été garçon où déjà".split()
    rng = random.Random(2)
    data = [(i, " ".join(rng.choice(fr if i % 2 else WORDS) for _ in range(40)), "fr" if i % 2 else "en") for i in range(120)]
    data += [(900, None, "en"), (901, "", "en"), (902, "123 !", None), (903, "la forêt était déjà où le garçon", None), (None, "the river of stone and the garden", "en"), (1, data[1][1], "fr")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    net = langid.learn(docs)
    found = langid.identify(docs, net).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(data)
    assert all(by[i]["lang_pred"] == lang for i, _, lang in data[:120])
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(120))
    assert [by[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "fr"]
    assert all(0 <= r["score"] <= 1 for r in found)
    assert langid.learn(docs.limit(0)) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(docs.limit(0), net).count() == 0


def brute_pooled(net, raw):
    """Mean probabilities over all bytes of a text, one byte and one unit's sum at a time, by the formulas."""
    w, h, step = {k: v.astype(float) for k, v in net.weights.items()}, langid.UNITS, langid.SEGMENT
    total = np.zeros(len(net.labels))
    for piece in (raw[k : k + step] for k in range(0, len(raw), step)):
        states = {}
        for d in "fb":
            state, states[d] = np.zeros(h), {}
            for t in range(len(piece)) if d == "f" else reversed(range(len(piece))):
                given, own, c = w[f"x{d}"][piece[t]], state @ w[f"u{d}"], w[f"c{d}"]
                reset, update = (np.clip(0.25 * (given[a : a + h] + c[a : a + h] + own[a : a + h]) + 0.5, 0, 1) for a in (0, h))
                new = np.clip(given[2 * h :] + reset * (own[2 * h :] + c[2 * h :]), -1, 1)
                state = update * state + (1 - update) * new
                states[d][t] = state
        for t in range(len(piece)):
            p = np.exp(states["f"][t] @ w["vf"] + states["b"][t] @ w["vb"] + w["o"])
            total += p / p.sum()
    return total / len(raw)


def test_language_id_reads_whole_texts(spark, monkeypatch):
    texts = [prose(k, 25) for k in range(6)] + [prose(7, 600), "é", "river " * 8 + "x"]
    net = langid.Network(["a", "b", "c"], seed=3)
    langs, scores = langid.predict(net, pa.array(texts))
    for text, lang, score in zip(texts, langs, scores):
        p = brute_pooled(net, text.encode())
        assert lang == net.labels[int(p.argmax())] and score == pytest.approx(p.max(), abs=1e-5)
    # segments of training: all places of all texts may be drawn, what repeats is learned from once, held-out rows never
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    data = [(k, prose(1000 + k, 50), "en" if k % 2 else "fr", "x") for k in range(60)] + [(ids[0], prose(1000 + ids[0], 50), "en" if ids[0] % 2 else "fr", "y")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, places string")
    cut = lambda t: {t.encode()[k : k + langid.SEGMENT] for k in range(0, len(t.encode()), langid.SEGMENT)}
    got = [bytes(r["segment"]) for r in langid.training_segments(docs).collect()]
    assert sorted(got) == sorted(set().union(*[cut(t) for k, t, _, _ in data if k in ids]))
    monkeypatch.setattr(langid, "SAMPLE_SEGMENTS", 60)
    few = [(r["lang"], bytes(r["segment"])) for r in langid.training_segments(docs).collect()]
    assert 30 <= len(few) <= 100 and {s for _, s in few} <= set(got) and {lang for lang, _ in few} == {"en", "fr"}
    assert sorted(few) == sorted((r["lang"], bytes(r["segment"])) for r in langid.training_segments(docs.repartition(5)).collect())


def test_sketches_never_part_similar_texts():
    """What two sketches differ in is no more than what the sets do, and most pairs that are not similar end there."""
    from docloom.llm import similar

    rng = np.random.default_rng(5)
    ended = 0
    for k in range(400):
        n = int(rng.integers(0, 700))
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        shared = a[: int(len(a) * rng.random())]
        b = np.unique(np.concatenate([shared, rng.integers(-(2**63), 2**63 - 1, int(rng.integers(0, 2 * n + 1)))]))
        apart = len(np.setxor1d(a, b))
        least = similar.least_difference(similar.sketch(a), similar.sketch(b))
        assert least == similar.least_difference(similar.sketch(b), similar.sketch(a)) <= apart
        ended += 9 * least > len(a) + len(b)
        assert 9 * least <= len(a) + len(b) or 9 * len(np.intersect1d(a, b)) < 4 * (len(a) + len(b))
    assert ended > 300
    assert similar.least_difference(similar.sketch(np.empty(0, np.int64)), similar.sketch(np.arange(200))) <= 200
