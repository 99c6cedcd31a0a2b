"""The engine on small documents: the three linked documents, entries, errors, sources, stream."""

import gzip
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.functions.patterns import Pattern
from docloom.operators import resolve
from docloom.operators.catalog import CatalogQuery, page_envelope
from docloom.operators.scope import ScopeQuery
from docloom.plans.engine import Engine
from docloom.schema import RequestError, ResolutionError
from docloom.sources import markdown, roff, tldr, trees

LINKED = {
    "harbour": "# Harbour\n\nShips wait, then sail to the [strait](strait.md).\n\nThe tide bell rings at noon.\n\n## Signals\n\n- `--lamp`, `-L`: light the lamp\n- `--flag`: raise a flag\n\n### At night\n\nOnly lamps are seen.\n",
    "strait": "# Strait\n\nBeyond lies the [island](island.md).\n\nA tide bell warns of rocks.\n\n## Signals\n\n- `--lamp`: answer a lamp\n",
    "island": "# Island\n\nBoats return to the [harbour](harbour.md).\n\nNo tide bell is heard here.\n",
}


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.of_markdown(spark, LINKED)


def keys(df):
    return [r["doc_key"].removeprefix("documents/") for r in df.orderBy("place").collect()]


def test_scope_closure(engine):
    found = engine.scope(["harbour"], follow_links=True)
    assert keys(found.documents) == ["harbour", "strait", "island"] and found.frontier.count() == 0 and found.edges.count() == 3
    rows = engine.scope_search(found, "tide bell").collect()
    assert [r["total"] for r in rows] == [3, 3, 3] and [r["node"] for r in rows] == ["root"] * 3
    none = engine.scope(["harbour"], follow_links=True, max_depth=0)
    assert [(r["to_key"], r["reason"]) for r in none.frontier.collect()] == [("documents/strait", "max-depth")]
    two = engine.scope(["harbour"], follow_links=True, max_documents=2)
    assert [(r["to_key"], r["reason"]) for r in two.frontier.collect()] == [("documents/island", "max-documents")]
    both = engine.scope(["strait", "harbour"])
    assert [(r["doc_key"], r["n_choices"]) for r in engine.scope_explain(both, "--lamp").collect()] == [("documents/strait", 1), ("documents/harbour", 1)]


def test_views(engine):
    assert engine.read("harbour", ["-L", "1"]).startswith('*Outline 1*\n\n<a id="signals"></a>\n## Signals')
    assert "Only lamps are seen." in engine.read("harbour", ["1"]) and "Only lamps are seen." in engine.read("harbour", ["1", "1.1"])
    around = engine.search("harbour", "raise", context_lines=1).first()["context"]
    assert [r["matched"] for r in around] in ([False, True], [False, True, False]) and "--lamp" in around[0]["text"]
    assert "--lamp" in engine.explain("harbour", "lamp")
    assert "`1/e2` (`option-flag`) --flag" in engine.outline_markdown("harbour")
    hit = engine.search("harbour", "light the").first()
    assert hit["node"] == "1/e1" and hit["total"] == 1
    assert engine.search("harbour", "Harbour", case="sensitive").count() == 0  # the title owns nothing
    for call, code in ((lambda: engine.explain("harbour", "tide bell"), "SelectorFoundOnlyInText"), (lambda: engine.explain("harbour", "1"), "ExplanationRequiresEntry"), (lambda: engine.read("harbour", ["nothing"]), "UnknownSelector"), (lambda: engine.full("delta"), "NotFound")):
        with pytest.raises(ResolutionError) as e:
            call()
        assert e.value.code == code
    assert engine.request(json.dumps({"input": {"selector": "strait"}, "view": {"kind": "full"}})).startswith("# Strait")
    with pytest.raises(RequestError):
        engine.request('{"input": {"selector": "strait"}, "view": {"kind": "full", "x": 1}}')
    assert engine.page("abcdef", 2, 3) == "[page chars=2..5 totalChars=6 nextChar=5]\ncde"
    assert [r["logical_path"] for r in engine.find(pattern="a", limit=5).collect()] == ["harbour", "island", "strait"]
    assert engine.doctor().first()["outcome"] == "healthy"


def test_patterns_that_could_run_away_are_refused():
    for text in ("(a+)+$", "((a|b)*c)+", "(?:x{2,})*"):
        with pytest.raises(RequestError):
            Pattern(text, "regex")
    for text in ("(ab)+", "[(a+)]+", r"\(a+\)+", "(a+)?b"):
        assert Pattern(text, "regex").java


def test_requests_are_checked_first():
    for bad in (dict(pattern=""), dict(limit=0), dict(source="a", manual_section="1"), dict(pattern="a(?=b)", syntax="regex"), dict(pattern="a*", syntax="regex"), dict(pattern="x" * 5000)):
        with pytest.raises(RequestError):
            CatalogQuery(**bad)
    for bad in (dict(roots=()), dict(roots=("a",) * 17), dict(roots=("a",), max_depth=3), dict(roots=("a",), follow_links=True, max_depth=40), dict(roots=("a", "b"), follow_links=True, max_documents=1)):
        with pytest.raises(RequestError):
            ScopeQuery(**bad)
    assert Pattern("Abc", case="smart").ignores_case is False and Pattern(r"\S+x", "regex", "smart").ignores_case is True
    assert page_envelope(10, 20, 5) == {"total": 10, "returned": 0, "offset": 10, "truncated": False, "next_offset": None}
    assert resolve.plan(resolve.Policy.COMBINED, False) == ("any", "optional")


HOSTILE = ["####### seven\n#nospace\n# \n## Title ##\n\nA\n===\n", "| a |\n|---|---|\n| 1 | 2 | 3 |\n|\n", "- ``: x\n- `-a` no delimiter\n- `-b`: ok\n", "> q\n\n<div>\n\n![i](x)\n\n[^1]: f\n", "﻿# é\x07 中文 🎉\n\n```\nunclosed", " \n\t\n", "* a\n  * b\n    * c\n\n1) x\n2) y\n" + "- " * 80]


@pytest.mark.parametrize("text", HOSTILE)
def test_hostile_markdown(text):
    parsed = markdown.parse(text)
    paths = [n.path for n in parsed.nodes]
    assert len(paths) == len(set(paths)) and len({n.id for n in parsed.nodes}) == len(paths)
    out = markdown.render(parsed, "x")
    for _, a, b in out.ranges:
        out.text.encode()[a:b].decode()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="#-*`[]()|>:_ \n\tab1é", max_size=200))
def test_markdown_never_fails(text):
    parsed = markdown.parse(text)
    again = markdown.parse(text)
    assert parsed == again and len({n.path for n in parsed.nodes}) == len(parsed.nodes)
    markdown.render(parsed, "x")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=".\\\"'SHPTIBfeno \nab(1)", max_size=200))
def test_roff_never_fails(text):
    assert roff.parse(text) == roff.parse(text)


def test_manual_pages():
    page = roff.parse('.TH TAR 1\n.SH NAME\ntar \\- an archiver\n.SH OPTIONS\n.TP\n.BR \\-c ", " \\-\\-create\nMake it.\n.TP\n.B \\-x\n.TQ\n.B \\-\\-extract\nTake \\fIall\\fP.\n.SS Deep\n.nf\na  b\n.fi\n.TS\nl l.\nx\ty\n.TE\n.SH "SEE ALSO"\n.BR gzip (1)\n')
    assert [(n.path, n.id) for n in page.nodes if n.kind == "document-section"] == [("1", "name-1"), ("2", "options-2"), ("2.1", "deep-3"), ("3", "see-also-4")]
    entries = [n for n in page.nodes if n.kind == "document-entry"]
    assert [e.names for e in entries] == [["-c", "--create"], ["-x", "--extract"]]
    assert [b.type for b in page.blocks] == ["paragraph", "definition-list", "preformatted", "table", "paragraph"]
    assert [(x["name"], x["manual_section"]) for x in page.links if x["kind"] == "manual"] == [("gzip", "1")]
    assert roff.mdoc_inline("Op Fl Fl help Ar file".split()) == "[--help file]"
    assert roff.redirect('.\\" c\n.so man1/x.1\n') == "man1/x.1" and roff.redirect(".so a\ntext") is None
    assert [roff.distance_lines(x) for x in (None, "2", "1i", "40u", "x")] == [1, 2, 6, 1, 1]


def test_tldr():
    assert tldr.command_parts(r"tar {{[-c|--create]}} {{f}} \{\{x\}\}") == [("text", "tar --create "), ("placeholder", "f"), ("text", " {{x}}")]
    with pytest.raises(ValueError):
        tldr.parse("no title")


def test_trees(spark, tmp_path):
    home = tmp_path / "docs"
    (home / "a").mkdir(parents=True)
    (home / "a" / "x.md").write_text("# X")
    (home / "a" / "x.markdown").write_text("# other")
    (home / "loop").symlink_to(home)
    assert trees.walk(str(home)) == [("a/x", str(home / "a" / "x.md"))]
    man = tmp_path / "man"
    (man / "man1").mkdir(parents=True)
    (man / "de" / "man1").mkdir(parents=True)
    (man / "man1" / "tool.1.gz").write_bytes(gzip.compress(b".TH T 1\n.SH N\nx\n"))
    (man / "man1" / "alias.1").write_text(".so man1/tool.1\n")
    (man / "man1" / "round.1").write_text(".so man1/round.1\n")
    (man / "man1" / "wrong.8").write_text("x")
    (man / "de" / "man1" / "tool.1").write_text("x")
    rows = {(r["name"], r["locale_rank"]) for r in trees.manual_files(spark, [str(man)], "de_DE").collect()}
    assert rows == {("tool", 2), ("alias", 2), ("round", 2), ("tool", 1)}
    text, alias = trees.load_manual(str(man), str(man / "man1" / "alias.1"))
    assert text.startswith(".TH T") and alias == "man1/tool.1"
    with pytest.raises(RequestError):
        trees.load_manual(str(man), str(man / "man1" / "round.1"))
    assert [trees.detect_format(p) for p in ("a.md", "a.md.gz", "a.1", "b.mdoc", "c.3type.zst", "d.txt")] == ["markdown", None, "roff", "roff", "roff", None]
    config = tmp_path / "s.toml"
    config.write_text("[sources.b]\n[sources.a]\n[sources.z]\npriority = 5\n[sources.low]\npriority = 0\n")
    assert [s["name"] for s in trees.load_sources(str(config))] == ["z", "a", "b", "low"]
    assert trees.read_tree(spark, str(home / "a")).count() == 2


def test_alias_chains(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "page string, target string")
    assert {tuple(r) for r in resolve.alias_chain(edges).collect()} == {("a", "c", 2), ("b", "c", 1)}


def test_stream(spark, tmp_path):
    from docloom.streaming.watch import current, watch

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("# A\n\ntext")
    args = (spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"))
    watch(*args).awaitTermination()
    (folder / "b.1").write_text(".TH B 1\n.SH NAME\nb\n")
    watch(*args).awaitTermination()
    rows = current(spark, str(tmp_path / "out")).orderBy("doc_key").collect()
    assert [(r["title"], r["batch"]) for r in rows] == [("A", 0), ("B", 1)]


def test_all_names_are_resolved(spark, tmp_path):
    from docloom.plans.driver import QUERIES

    urls = ["http://www.a.com/en/5.html", "http://b.org/en/9992", "http://cc.org/fr/9992.html", "http://b.org/fr/x", "http://b.org/de/9992/7001", "http://www.a.com/"]
    spark.createDataFrame([(u,) for u in urls], "url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, "t", "en", "src1", 1), (2, "t", "de", "x", 1), (3, "t", "de", None, 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    pages = {u: u.split("/", 3)[3].removesuffix(".html") for u in urls}
    manuals = {"src1": "1", "x": "2"}
    asked = {p.rsplit("/", 1)[-1] for p in pages.values()} - {""} | set(manuals)
    got = QUERIES["resolve_all_precedence"](spark, str(tmp_path)).collect()
    want = {(s, u) for s in asked for u, p in pages.items() if ("/" + p).endswith("/" + s)} | {(s, "1") for s in asked if s == "src1"} | {(s, "2") for s in asked if s == "x"}
    assert {(r["selector"], r["path"]) for r in got} == want and len(got) == len(want)
    found = {r["selector"]: (r["winner"], r["n_choices"]) for r in QUERIES["resolve_all_names"](spark, str(tmp_path)).collect()}
    # hosts of 5 and 6 letters have priorities 1 and -1: manuals come between
    assert found == {"5": ("documents/en/5", 1), "9992": ("sources/b.org/en/9992", 1), "x": ("sources/b.org/fr/x", 1), "7001": ("sources/b.org/de/9992/7001", 1), "src1": ("manual/1/src1", 1)}


def test_preferences_and_spellings(spark):
    from docloom.operators import resolve

    assert resolve.tldr_languages({"LANG": "fr-CA.UTF-8", "LANGUAGE": "de:C::pt_BR"}) == ["de", "pt_BR", "pt", "fr_CA", "fr", "en"]
    assert resolve.tldr_languages({"LANGUAGE": "de"}) == resolve.tldr_languages({"LANG": "C", "LANGUAGE": "de"}) == ["en"]
    assert resolve.tldr_platforms("macos")[:4] == ["osx", "macos", "common", "linux"]
    assert len(set(resolve.tldr_platforms("linux"))) == len(resolve.tldr_platforms("linux")) == 12
    assert resolve.command_suffixes(" ") == [".COM", ".EXE", ".BAT", ".CMD"]
    assert resolve.command_suffixes(".EXE; bat;.exe;a/b;") == [".EXE", ".bat"]
    names = spark.createDataFrame([(n, n) for n in ("git", "a.md", "..", ".rc", "v1.2/git")], "selector string, name string")
    found = {}
    for r in resolve.host_names(names, [".EXE"]).orderBy("cand_ord").collect():
        found.setdefault(r["selector"], []).append(r["name"])
    assert found == {"git": ["git", "git.EXE"], "a.md": ["a.md"], "..": ["..", "...EXE"], ".rc": [".rc", ".rc.EXE"], "v1.2/git": ["v1.2/git", "v1.2/git.EXE"]}


def test_escapes(spark):
    from pyspark.sql import functions as F

    from docloom.functions import text as T

    rows = [(r"a_b_c _d_ \ `x` *y* [z](w) <&amp;> $1", "a b(c)\\"), (None, None), ("", "")]
    got = spark.createDataFrame(rows, "t string, u string").select(T.escape_markdown(F.col("t")), T.link_target(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [(r"a_b_c \_d\_ \\ \`x\` \*y\* \[z\](w) \<&amp;amp;\> \$1", r"a%20b\(c\)" + "\\\\"), (None, None), ("", "")]


def test_parsed_rows_are_held_in_small_pieces():
    """A batch of Spark's has up to 10,000 documents; what leaves the parser is bounded by their bytes, whatever the batch."""
    import pyarrow as pa

    from docloom.plans import index

    body = b"# T\n\n## One\n\n- `--all`: everything\n\n" + b"word " * 2_000
    contents = [body] * 300 + [None, b"", b"x " * index.PARSED_BYTES] + [body] * 3
    keys = [str(k) for k in range(len(contents))]
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(["markdown"] * len(keys)), pa.array(contents, pa.binary())], names=["doc_key", "format", "content"])
    out = list(index._parsed(iter([batch])))
    assert [k for b in out for k in b.column(0).to_pylist()] == keys
    sizes = [[len(contents[int(k)] or b"") for k in b.column(0).to_pylist()] for b in out]
    assert all(len(x) == 1 or sum(x) <= index.PARSED_BYTES for x in sizes) and len(out) > 3
    assert list(index._parsed(iter([batch.slice(0, 0)])))[0].num_rows == 0
