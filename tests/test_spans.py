"""Spans, owners, trees, admission, aliases and the linear matcher against brute force."""

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docloom.functions.linear import LinearPattern, pattern_of, spelled
from docloom.functions.patterns import Pattern
from docloom.operators import admission, aliases, outline, scope, search, spans, stabbing
from docloom.schema import RequestError, ResolutionError


@pytest.fixture
def ranges(spark):
    """Many ranges, also for few rows."""
    held = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


TEXTS = ["", "one\ntwo\n\nthree", "é to a\nTo bé\r\nto", "end to\n", "to " * 400, "\n\n", "日本\nto 日本\n"]


def line_column(text, at):
    before = text[:at]
    return before.count("\n") + 1, len(before) - (before.rfind("\n") + 1) + 1


def test_matches_over_lines(spark, monkeypatch):
    monkeypatch.setattr(spans, "MAX_OCCURRENCES", 5)
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "doc_key long, text string")
    pattern = Pattern(r"[a-zé]\n+\w|to|本", syntax="regex")
    want = []
    for k, text in enumerate(TEXTS):
        hit, last, n = 0, None, 0
        own = []
        for m in re.finditer(r"(?i)[a-zé]\n+\w|to|本", text):
            (sl, sc), (el, ec) = line_column(text, m.start()), line_column(text, m.end())
            start = len(text[: m.start()].encode())
            key = (sl, el, start // 8)
            hit, n = (hit, n + 1) if key == last else (hit + 1, 1)
            last = key
            own.append([k, hit, m[0], start, len(text[: m.end()].encode()), sl, sc, el, ec, n])
        want += [(*r[:-1], sum(x[1] == r[1] for x in own)) for r in own if r[-1] <= 5]
    nodes = docs.where("text IS NOT NULL").select("doc_key", F.explode(F.sequence(F.lit(0), F.octet_length("text") + 8, F.lit(8))).alias("start")).select("doc_key", "start", (F.col("start") + 8).alias("stop"), (F.col("start") / 8).cast("long").alias("node"))
    found = spans.grouped_hits(spans.placed(spans.occurrences(docs, pattern), docs), nodes)
    assert rows_of(found, "doc_key", "ordinal", "matched", "start", "stop", "start_line", "start_column", "end_line", "end_column", "occurrence_count") == sorted(want, key=repr)
    nobody = spans.grouped_hits(spans.placed(spans.occurrences(docs, pattern), docs), nodes.where("start >= 16"))
    assert nobody.where("start < 16").count() == 0


PAGES = [
    "<html><head><title>A &amp; B</title><style>p{}</style></head><body><p>one<b>two</b> &#233;t&#xE9;<br><br>&unknown; x < y &lt;the&gt;</p><!-- the --><script>the</script><p>the end",
    "plain & simple", "", "<p></p>", "&nbsp;&copy;the<td>the</td><td>t<i>h</i>e</td>", "<p>the</p>\n<p>the</p>",
]


def visible(page):
    """Characters shown, each with its range of bytes in the page and whether it moves along with it."""
    out, at = [], 0
    while at < len(page):
        rest = page[at:]
        m = re.match(r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", rest)
        r = re.match(r"&(?:#x[0-9a-fA-F]+|#[0-9]+|amp|lt|gt|nbsp|copy);", rest)
        size = len((m or r)[0]) if m or r else 1
        a, z = len(page[:at].encode()), len(page[: at + size].encode())
        if m:
            breaks = re.match(r"(?i)</?([a-z0-9]+)", m[0])
            if breaks and breaks[1].lower() in spans.BREAKING and out and out[-1][0] != "\n":
                out.append(("\n", a, z, False))
        elif r:
            out.append((html.unescape(r[0]), a, z, False))
        else:
            out.append((rest[0], a, z, True))
        at += size
    return out


def test_visible_spans(spark):
    pages = spark.createDataFrame(list(enumerate(PAGES)) + [(50, None)], "doc_key long, html string")
    pattern = r"the|[&\n]+|\w\w<|é|x . y"
    want = []
    for k, page in enumerate(PAGES):
        shown = visible(page)
        text = "".join(c for c, *_ in shown)
        for m in re.finditer(pattern, text):
            want.append((k, m[0], len(text[: m.start()].encode()), len(text[: m.end()].encode()), shown[m.start()][1], shown[m.end() - 1][2]))
    found = spans.visible_spans(pages, Pattern(pattern, syntax="regex", case="sensitive"))
    assert rows_of(found, "doc_key", "matched", "start", "stop", "source_start", "source_stop") == sorted(want, key=repr)
    assert len(want) >= 18


def test_folded_search(spark):
    texts = ["Straße STRASSE strasse", "İstanbul i̇stanbul", "eﬀort EFFORT eﬃcient", "ΣΊΣΥΦΟΣ σίσυφος ςσΣ", "ẞß ſs", "ŉ ʼn", "plain", "", "ΐ ΐ", "ss" * 300, "Ǆungla 𐐀𐐨", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_key long, text string")
    for needle in ("SS", "strasse", "i̇s", "ff", "f", "σ", "ΣΊ", "ʼn", "ΐ", "ǆ", "𐐀"):
        want = []
        for k, text in enumerate(texts):
            owner = [i for i, c in enumerate(text or "") for _ in c.casefold()]
            for n, m in enumerate(re.finditer(re.escape(needle.casefold()), (text or "").casefold())):
                want.append((k, n + 1, owner[m.start()], owner[m.end() - 1] + 1))
        assert rows_of(spans.folded_matches(docs, needle), "doc_key", "hit", "start_char", "stop_char") == sorted(want, key=repr), needle


def test_only_lengths_are_put_in_order(spark):
    """Case folding is Python's for texts of all sorts, and the windows that lay segments out get lengths, not the texts."""
    texts = ["".join(map(chr, range(a, min(a + 5_000, 0xD800)))) for a in range(1, 0xD800, 5_000)] + ["é ß à", "µ", "ſ é", "ẞ", "Œuvre ß", "ﬀ\xff", "ς", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_key long, text string")
    low = {r["doc_key"]: (r["text"], r["f"]) for r in docs.withColumn("f", spans.case_folded(F.col("text"))).where("doc_key > 11").collect()}
    assert all(f == t.casefold() for t, f in low.values()) and len(low) == 8
    segments = spans.folded_segments(docs)
    assert {r["doc_key"]: r["text"] for r in spans.texts_of(segments).collect()} == {k: "".join(spans.EXPANDING.get(c, c) for c in t) for k, t in enumerate(texts) if t}
    # above the windows nothing is measured any more, so no text had to come along
    above, window, _ = segments.drop("text")._jdf.queryExecution().optimizedPlan().toString().partition("Window [")
    assert window and "length(" not in above


def test_context_windows(spark):
    lines = spark.createDataFrame([(1, i, f"line {i}") for i in range(1, 31)], "doc_key long, line_no long, text string")
    hits = [(1, 1, "a", 3, 3, [5, 2]), (1, 2, "a", 6, 8, [1]), (1, 3, "b", 8, 8, [9]), (1, 4, "b", 20, 20, [4, 4]), (1, 5, "b", 25, 26, [1]), (1, 6, "b", 30, 30, [7])]
    frame = spark.createDataFrame(hits, "doc_key long, ordinal long, node string, start_line long, end_line long, columns array<int>")
    got = spans.context_windows(frame, lines, 2).orderBy("window", "line_no").collect()
    shown = {w: [r["line_no"] for r in got if r["window"] == w] for w in {r["window"] for r in got}}
    assert shown == {1: list(range(1, 11)), 2: [6, 7, 8, 9, 10], 3: list(range(18, 31))}
    marks = {(r["window"], r["line_no"]): r["columns"] for r in got if r["matched"]}
    assert marks == {(1, 3): [2, 5], (1, 6): [1], (1, 7): [1], (1, 8): [1], (2, 8): [9], (3, 20): [4], (3, 25): [1], (3, 26): [1], (3, 30): [7]}


def test_context_windows_name_all_columns(spark, tmp_path):
    """A line with more matches than a hit shows."""
    from docloom.plans.sweeps import QUERIES

    n = 2 * spans.MAX_OCCURRENCES + 3
    spark.createDataFrame([(1, "one\n" + "on." * n + "\nlast")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["search_context_windows"](spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["line_no"], r["matched"], r["columns"]) for r in got] == [(1, False, None), (2, True, ",".join(str(3 * i + 1) for i in range(n))), (3, False, None)]


def held_by(intervals, doc, pos):
    found = [(s, o, n) for d, s, e, o, n in intervals if d == doc and s <= pos < e]
    return max(found)[2] if found else None


def test_innermost_owner(spark, ranges):
    rng = random.Random(3)
    intervals = [("nested", i, 1000 - i, i, f"n{i}") for i in range(100)]  # a hundred levels
    intervals += [("hot", s := rng.randrange(5000), s + rng.choice([0, 1, 5, 50, 3000]), i, f"h{i}") for i in range(1500)] + [("hot", 0, 6000, 9999, "all")]
    intervals += [(f"d{i % 40}", i, i + 7, i, f"x{i}") for i in range(200)] + [(None, 1, 9, 1, "none"), ("ties", 2, 9, 1, "a"), ("ties", 2, 9, 2, "b"), ("ties", 2, 4, 3, "c")]
    positions = [("nested", i, p) for i, p in enumerate(range(-1, 1002, 3))] + [("hot", i, rng.randrange(-5, 7000)) for i in range(3000)]
    positions += [(f"d{i % 45}", i, i + 3) for i in range(300)] + [(None, 1, 5), ("ties", 1, 2), ("ties", 2, 4), ("ties", 2, 4), ("ties", 3, 9)]
    got = stabbing.innermost(spark.createDataFrame(positions, "doc_key string, id long, pos long"), spark.createDataFrame(intervals, "doc_key string, start long, stop long, ord long, node string"))
    assert rows_of(got, "doc_key", "id", "pos", "node") == sorted(((d, i, p, held_by(intervals, d, p)) for d, i, p in positions), key=repr)


def greedy(sizes, budget):
    used, out = 0, []
    for s in sizes:
        out.append(used + s <= budget)
        used += s if out[-1] else 0
    return out


def test_admission(spark, ranges):
    rng = random.Random(9)
    cases = [([5, 9, 3, 8, 1, 0, 4], 15), ([2, 14, 14, 20], 15), ([20, 30], 7), ([], 5), ([0, 0, 1], 0), ([3] * 50, 100), ([rng.choice([1, 2, 3, 40, 700, 5000]) for _ in range(400)], 9000), ([rng.randrange(1, 1 << rng.randrange(1, 20)) for _ in range(500)], 1 << 20)]
    for sizes, budget in cases:
        items = spark.createDataFrame([(f"k{i}", i // 2, s) for i, s in sorted(enumerate(sizes), key=lambda x: hash(x))], "key string, order long, size long")
        got = {r["key"]: r["admitted"] for r in admission.admit(items, budget).collect()}
        order = sorted(range(len(sizes)), key=lambda i: (i // 2, f"k{i}"))
        assert [got[f"k{i}"] for i in order] == greedy([sizes[i] for i in order], budget)


def test_scope_bytes_and_unresolved(spark):
    docs = spark.createDataFrame([("root", 10), ("big", 95), ("mid", 30), ("small", 5), ("far", 50), ("tiny", 1)], "doc_key string, n_bytes long")
    links = [("root", "big", 0), ("root", "mid", 1), ("root", "nowhere", 2), ("root", "small", 3), ("mid", "far", 0), ("small", "tiny", 0), ("small", "big", 1), ("tiny", "root", 0)]
    edges = spark.createDataFrame([(a, b, "document", k) for a, b, k in links], "from_key string, to_key string, kind string, link_ord int")
    found = scope.closure(docs, edges, scope.ScopeQuery(("root", "lost"), True, 5, 10, max_bytes=90))
    assert [tuple(r) for r in found.documents.orderBy("place").select("doc_key", "depth").collect()] == [("root", 0), ("mid", 1), ("small", 1), ("tiny", 2)]
    assert rows_of(found.frontier, "from_key", "to_key", "reason") == [("mid", "far", "max-content-bytes"), ("root", "big", "max-content-bytes"), ("small", "big", "max-content-bytes")]
    assert rows_of(found.unresolved, "from_key", "to_key") == [("root", "nowhere"), (None, "lost")]
    two = scope.closure(docs, edges, scope.ScopeQuery(("root",), True, 5, 3, max_bytes=90))
    assert rows_of(two.documents, "doc_key") == [("mid",), ("root",), ("small",)]
    assert ("mid", "far", "max-documents") in rows_of(two.frontier, "from_key", "to_key", "reason")
    with pytest.raises(ResolutionError, match="bytes"):
        scope.closure(docs, edges, scope.ScopeQuery(("root", "big"), max_bytes=90))


def test_alias_chains(spark):
    chain = {f"c{i}": f"c{i + 1}" for i in range(20)} | {"a": "b", "b": "a", "self": "self", "in": "t1", "t1": "t2", "t2": "t1", "gone": "nowhere", "dot": "page"}
    ring = {f"r{i}": f"r{(i + 1) % 16}" for i in range(16)} | {f"l{i}": f"l{(i + 1) % 17}" for i in range(17)}
    to = chain | ring
    pages = sorted(set(to) | {"c20", "page", "alone"})
    got = {r["node"]: (r["status"], r["target"], r["hops"]) for r in aliases.alias_targets(spark.createDataFrame([(p,) for p in pages], "node string"), spark.createDataFrame(list(to.items()), "node string, to string")).collect()}
    want = {p: ("found", p, 0) for p in ("c20", "page", "alone")} | {f"c{i}": ("found", "c20", 20 - i) if i >= 4 else ("too-long", None, 16) for i in range(20)}
    want |= {p: ("cycle", None, 16) for p in ("a", "b", "self", "in", "t1", "t2", *(f"r{i}" for i in range(16)))} | {f"l{i}": ("too-long", None, 16) for i in range(17)}
    assert got == want | {"gone": ("missing", None, 1), "dot": ("found", "page", 1)}


def test_chains_that_come_into_a_cycle_late(spark):
    """After 16 hops these are still before a cycle, whose least page is below all that they pass."""
    to = {i: i - 1 for i in range(101, 121)} | {100: 1, 1: 2, 2: 1}
    frame = spark.createDataFrame(list(to.items()), "node long, to long")
    got = {r["node"]: (r["status"], r["target"], r["hops"]) for r in aliases.alias_targets(frame.select("node"), frame).collect()}
    assert got == {i: ("too-long" if i > 115 else "cycle", None, 16) for i in to}


def test_subtree_totals_and_breadcrumbs(spark):
    rng = random.Random(4)
    rows = [(d, i, rng.randrange(1, 7), rng.randrange(10) if i % 5 else None) for d in range(6) for i in range(d * 9)]
    got = outline.subtree_totals(spark.createDataFrame(rows, "doc_key long, ord long, level int, n int"), ["n"])
    want = []
    for d, i, level, _ in rows:
        after = [r for r in rows if r[0] == d and r[1] > i]
        stop = next((r[1] for r in after if r[2] <= level), 1 << 40)
        want.append((d, i, sum(r[3] or 0 for r in rows if r[0] == d and i <= r[1] < stop)))
    assert rows_of(got, "doc_key", "ord", "total_n") == sorted(want, key=repr)
    nodes = [("root", "document-root", None, "Doc"), ("root/e1", "document-entry", None, "--x"), ("0", "tldr", None, "quick"), ("1", "document-section", [1], "One"), ("1.2", "document-section", [1, 2], "Two"), ("1.2/e1", "document-entry", [1, 2], "-v")]
    frame = spark.createDataFrame([(7, p, k, c, t) for p, k, c, t in nodes], "doc_key long, path string, kind string, coords array<int>, title string")
    trails = {r["path"]: [tuple(b) for b in r["breadcrumbs"]] for r in outline.breadcrumbs(frame).collect()}
    assert trails == {"root": [], "0": [], "root/e1": [("root", "Doc")], "1": [], "1.2": [("1", "One")], "1.2/e1": [("1", "One"), ("1.2", "Two")]}


def test_linear_matcher(spark):
    hostile = "a" * 60_000 + "!"
    docs = spark.createDataFrame([(1, f"x\n{hostile}"), (2, "aaab\nÉté 42\n"), (3, None)], "doc_key long, text string")
    began = time.time()
    for text, want in ((r"(a|aa)+$", []), (r"a*a*a*a*a*a*b", [(2, 1)]), (r"(a?){30}a{30}$", []), (r"(a+)+$", []), (r"(?:\w\w?)+ \d+", [(2, 2)])):
        pattern = pattern_of(text, "regex")
        assert isinstance(pattern, LinearPattern)
        assert rows_of(search.hits(docs, pattern), "doc_key", "line_no") == want, text
        with pytest.raises(RequestError):
            Pattern(text, "regex")
    assert time.time() - began < 60
    assert isinstance(pattern_of("a.*b", "regex"), Pattern) and isinstance(pattern_of("(a|aa)+$"), Pattern)
    assert spelled(r"[\w-]\d\p{Lu}") == r"[\pL\pM\p{Nd}\p{Nl}\p{Pc}-][\p{Nd}]\p{Lu}"
    for bad in (r"(a|b)+\b", r"([\Wx]|y)+", r"(a|b)*", r"(a|b)+[", ""):
        with pytest.raises(RequestError):
            LinearPattern(bad)
