"""Spans of text: matches of whole texts, maps between a text and its source, lines and columns, context windows.

Every look-up by position is one sweep: marks (segments, lines, nodes) and the positions that ask for them are put in one
order by document and offset, and the last mark carries on to the positions behind it. A span has two ends, so it asks
twice and its halves meet in an aggregate of the same partitioning; nothing is joined by ranges.
Offsets are of bytes unless called chars; all count from 0 and are half open, lines and columns from 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.patterns import Pattern
from docloom.schema import MAX_OCCURRENCES

#: HTML elements that begin and end a line of visible text.
BREAKING = "address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr li main nav ol p pre section table td th title tr ul".split()
#: Parts of a page that together are all of it: what is never shown, tags, character references, text.
HTML_TOKEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>|&#[0-9]{1,7};|&#x[0-9a-f]{1,6};|&[a-z][a-z0-9]*;|[^<&]+|[<&]"
#: Character references by name that are decoded; others stay as they are.
REFERENCES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—", "laquo": "«", "raquo": "»"}
#: Characters whose full case folding is longer than they are.
EXPANDING = {chr(i): chr(i).casefold() for i in range(0x110000) if len(chr(i).casefold()) > 1}
#: Characters whose folding is one other than their lower case; the lower case of a final sigma is among them.
_OTHER = {x: x.casefold() for x in sorted({chr(i).lower() for i in range(0x110000)} | set("ς")) if len(x) == 1 == len(x.casefold()) and x.casefold() != x}
#: Characters of Latin-1 that become no others or several once they are lower case.
_LATIN = {c: c for c in map(chr, range(0x100)) if c not in EXPANDING and c not in _OTHER}


def _class_of(characters: dict[str, str]) -> str:
    """The inside of a character class, neighbours as ranges."""
    codes, runs = sorted(map(ord, characters)), []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in runs)


def _bytes(c: str | Column) -> Column:
    return F.octet_length(c).cast("long")


def occurrences(docs: DataFrame, pattern: Pattern) -> DataFrame:
    """All matches of whole texts, over line breaks too: doc_key, nth, matched, start, stop, start_char, stop_char.

    docs: doc_key, text.  The stretches between matches and the matches are laid out one after the other and summed up, so a text's
    work is linear in its matches.
    """
    cut = docs.where(pattern.matches(F.col("text"))).select("doc_key", F.split("text", pattern.java, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern.java), F.lit(0)).alias("matched"))
    each = cut.select("doc_key", F.posexplode(F.arrays_zip("gap", "matched")).alias("n", "p"))
    # only lengths and matches are put in order, the stretches between them stay behind
    gap, match = F.col("p.gap"), F.col("p.matched")
    size, size_char = _bytes(gap) + F.coalesce(_bytes(match), F.lit(0)), F.length(gap) + F.coalesce(F.length(match), F.lit(0))
    rows = each.select("doc_key", "n", match.alias("matched"), size.alias("size"), size_char.alias("size_char"))
    upto = Window.partitionBy("doc_key").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum("size").over(upto)).withColumn("stop_char", F.sum("size_char").over(upto)).where("matched IS NOT NULL")
    return rows.select(
        "doc_key", (F.col("n") + 1).cast("long").alias("nth"), "matched", (F.col("stop") - _bytes("matched")).alias("start"), "stop", (F.col("stop_char") - F.length("matched")).alias("start_char"), "stop_char"
    )


def latest(asked: DataFrame, marks: DataFrame, at: str = "at") -> DataFrame:
    """asked (doc_key, at, ...) with the struct `mark`: of the document's marks (doc_key, at, mark) the last at or before."""
    carried = [c for c in asked.columns if c not in ("doc_key", at)]
    both = marks.select("doc_key", at, F.lit(0).alias("_asks"), "mark").unionByName(asked.withColumn("_asks", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy("doc_key").orderBy(at, "_asks").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("mark", F.last("mark", ignorenulls=True).over(upto)).where("_asks = 1").select("doc_key", at, *carried, "mark")


def _both_ends(spans: DataFrame, key: str, start: str, stop: str) -> DataFrame:
    """doc_key, key, end (0, 1), at: the two places of each span."""
    return spans.select("doc_key", key, F.posexplode(F.array(F.col(start), F.col(stop))).alias("end", "at"))


def mapped_spans(hits: DataFrame, segments: DataFrame) -> DataFrame:
    """Where hits on a derived text lie in its source: doc_key, hit, source_start, source_stop.

    hits: doc_key, hit, start, stop (not empty).  segments: doc_key, start, stop, source_start, source_stop, linear; in the derived text they
    follow each other without overlap. In a linear segment an offset moves along with the source's, an opaque one stands for its whole range;
    an end outside of all segments maps to 0.
    """
    ends = _both_ends(hits.withColumn("last", F.col("stop") - 1), "hit", "start", "last")
    marks = segments.select("doc_key", F.col("start").alias("at"), F.struct("start", "stop", "source_start", "source_stop", "linear").alias("mark"))
    found = latest(ends, marks)
    m, inside = F.col("mark"), F.col("at") < F.col("mark.stop")
    place = F.when(m["linear"], m["source_start"] + F.col("at") - m["start"] + F.col("end")).otherwise(F.when(F.col("end") == 0, m["source_start"]).otherwise(m["source_stop"]))
    found = found.withColumn("place", F.when(inside, place).otherwise(F.lit(0)).cast("long"))
    half = lambda k: F.max(F.when(F.col("end") == k, F.coalesce("place", F.lit(0).cast("long"))))
    return found.groupBy("doc_key", "hit").agg(half(0).alias("source_start"), half(1).alias("source_stop"))


def _mapped(tokens: DataFrame, size) -> DataFrame:
    """Segments from tokens (doc_key, n, token, shown, linear) in order; size measures both texts."""
    upto = Window.partitionBy("doc_key").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    measured = tokens.select("doc_key", "n", "linear", "shown", size("token").alias("n_token"), size("shown").alias("n_shown"))
    laid = measured.withColumn("source_stop", F.sum("n_token").over(upto)).withColumn("stop", F.sum("n_shown").over(upto))
    return laid.where("n_shown > 0").select(
        "doc_key", "n", (F.col("stop") - F.col("n_shown")).alias("start"), "stop", (F.col("source_stop") - F.col("n_token")).alias("source_start"), "source_stop", "linear", F.col("shown").alias("text")
    )


def html_segments(pages: DataFrame) -> DataFrame:
    """The visible text of pages (doc_key, html) as segments, in bytes: doc_key, n, start, stop, source_start, source_stop, linear, text.

    Runs of text are linear. A character reference is opaque, and so is the line break for a tag of a breaking element; there is none at the
    start and none after another.
    """
    tokens = pages.select("doc_key", F.posexplode(F.regexp_extract_all("html", F.lit(HTML_TOKEN), F.lit(0))).alias("n", "token"))
    token = F.col("token")
    name = F.lower(F.expr("substring(token, 2, length(token) - 2)"))
    number = F.when(name.startswith("#x"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 8)).try_cast("long")
    usable = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    # a character from its number by its UTF-32
    character = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    decoded = F.when(usable, character).when(number.isNull(), F.element_at(F.create_map(*[F.lit(x) for kv in REFERENCES.items() for x in kv]), F.expr("substring(token, 2, length(token) - 2)")))
    is_tag, is_reference = (token.startswith("<")) & (F.length(token) > 1), token.startswith("&") & (F.length(token) > 1)
    breaks = is_tag & token.rlike(rf"(?i)^</?(?:{'|'.join(BREAKING)})\b")
    tokens = tokens.withColumn("decoded", F.when(is_reference, decoded)).withColumn("breaks", breaks)
    tokens = tokens.withColumn("shown", F.when(F.col("breaks"), "\n").when(is_tag, "").otherwise(F.coalesce("decoded", "token")))
    before = Window.partitionBy("doc_key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("shown") != "", F.right("shown", F.lit(1))), ignorenulls=True).over(before)
    needless = F.col("breaks") & (last.isNull() | (last == "\n"))
    tokens = tokens.withColumn("_needless", needless).withColumn("shown", F.when(F.col("_needless"), "").otherwise(F.col("shown")))
    return _mapped(tokens.withColumn("linear", ~F.col("breaks") & F.col("decoded").isNull()), _bytes)


def texts_of(segments: DataFrame) -> DataFrame:
    """doc_key, text from segments with their texts."""
    whole = segments.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("s"))
    return whole.select("doc_key", F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"))


def visible_spans(pages: DataFrame, pattern: Pattern) -> DataFrame:
    """Matches on the visible text of pages (doc_key, html), with their places there and in the html, all in bytes."""
    segments = html_segments(pages)
    found = occurrences(texts_of(segments), pattern).withColumnRenamed("nth", "hit")
    return found.join(mapped_spans(found, segments.join(found.select("doc_key").distinct(), "doc_key", "left_semi")), ["doc_key", "hit"])


def _longer(token: Column) -> Column:
    """What a character becomes if that is several, else null."""
    return F.when(F.octet_length(token) <= 4, F.element_at(F.create_map(*[F.lit(x) for kv in EXPANDING.items() for x in kv]), token))


def _fold_tokens(text: Column) -> Column:
    """A text cut in characters that become several and runs of others; runs of Latin-1 are apart, as they need no look at the long class."""
    special, latin = _class_of(EXPANDING), _class_of(_LATIN)
    return F.regexp_extract_all(text, F.lit(f"[{latin}]++|[{special}]|[^{special}{latin}]+"), F.lit(0))


def case_folded(text: Column) -> Column:
    """Full case folding of a text."""
    low = F.lower(text)
    one = F.translate(low, "".join(_OTHER), "".join(_OTHER.values()))
    slow = F.array_join(F.transform(_fold_tokens(one), lambda t: F.coalesce(_longer(t), t)), "")
    # few texts hold more than lower case and the sharp s, and these need no look at every run of them
    rare = f"(?=[^{_class_of(_LATIN)}])[{_class_of({c: v for c, v in (EXPANDING | _OTHER).items() if c != 'ß'})}]"
    return F.when(F.length(text) == F.octet_length(text), low).when(low.rlike(rare), slow).otherwise(F.replace(low, F.lit("ß"), F.lit("ss")))


def folded_segments(docs: DataFrame) -> DataFrame:
    """The full case folding of texts (doc_key, text) as segments, in chars: a character that becomes several is opaque, runs of others are linear and keep their text."""
    tokens = docs.select("doc_key", F.posexplode(_fold_tokens(F.col("text"))).alias("n", "token")).withColumn("longer", _longer(F.col("token")))
    return _mapped(tokens.select("doc_key", "n", "token", F.coalesce("longer", "token").alias("shown"), F.col("longer").isNull().alias("linear")), lambda c: F.length(c).cast("long"))


def folded_matches(docs: DataFrame, needle: str) -> DataFrame:
    """Where texts (doc_key, text) hold the needle if both are case folded: doc_key, hit, start_char, stop_char of the text itself.

    Texts whose folding does not hold it are left out before anything is laid out. A match that begins or ends within what one
    character became covers that character.
    """
    needle = needle.casefold()
    if not needle:
        raise ValueError("the needle is empty")
    # behind explode the folding is worked out once a row, however often it is asked for
    holding = docs.select("doc_key", "text", F.explode(F.array(case_folded(F.col("text")))).alias("_folded")).where(F.col("_folded").contains(needle))
    literal = Pattern(needle, case="sensitive")
    found = occurrences(holding.select("doc_key", F.col("_folded").alias("text")), literal)
    hits = found.select("doc_key", F.col("nth").alias("hit"), F.col("start_char").cast("long").alias("start"), F.col("stop_char").cast("long").alias("stop"))
    return mapped_spans(hits, folded_segments(holding)).select("doc_key", "hit", F.col("source_start").alias("start_char"), F.col("source_stop").alias("stop_char"))


def line_starts(docs: DataFrame) -> DataFrame:
    """doc_key, line_no, at, start_char of every line of texts (doc_key, text)."""
    lines = docs.select("doc_key", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).select("doc_key", "n", F.octet_length("line").alias("size"), F.length("line").alias("size_char"))
    before = Window.partitionBy("doc_key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(F.col(c) + 1).over(before), F.lit(0)).cast("long")
    return lines.select("doc_key", (F.col("n") + 1).cast("long").alias("line_no"), total("size").alias("at"), total("size_char").alias("start_char"))


def placed(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Occurrences with start_line, start_column, end_line, end_column; columns count characters."""
    lines = line_starts(docs.join(found.select("doc_key").distinct(), "doc_key", "left_semi"))
    marks = lines.select("doc_key", "at", F.struct("line_no", "start_char").alias("mark"))
    ends = found.select("doc_key", "nth", F.posexplode(F.array(F.struct(F.col("start").alias("b"), F.col("start_char").alias("c")), F.struct(F.col("stop").alias("b"), F.col("stop_char").alias("c")))).alias("end", "e"))
    spots = latest(ends.select("doc_key", "nth", "end", F.col("e.b").alias("at"), F.col("e.c").alias("char")), marks)
    half = lambda k, v: F.max(F.when(F.col("end") == k, v))
    line, column = F.col("mark.line_no"), (F.col("char") - F.col("mark.start_char") + 1).cast("long")
    at = spots.groupBy("doc_key", "nth").agg(half(0, line).alias("start_line"), half(0, column).alias("start_column"), half(1, line).alias("end_line"), half(1, column).alias("end_column"))
    return found.join(at, ["doc_key", "nth"])


def all_hits(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """Neighbouring occurrences of the same lines and owner as one hit: node and ordinal beside each occurrence.

    places: as of :func:`placed`.  nodes: doc_key, start, stop, node, without overlap. An occurrence that no node owns is dropped.
    """
    marks = nodes.select("doc_key", F.col("start").alias("at"), F.struct("node", "stop").alias("mark"))
    owned = latest(places.withColumn("at", F.col("start")), marks).where("at < mark.stop").withColumn("node", F.col("mark.node")).drop("at", "mark")
    order = Window.partitionBy("doc_key").orderBy("start")
    same = reduce(lambda a, c: a & (F.lag(c).over(order) == F.col(c)), ["start_line", "end_line", "node"], F.lit(True))
    return owned.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("ordinal", F.sum("_new").over(order).cast("long")).drop("_new")


def grouped_hits(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """As :func:`all_hits`, with place and occurrence_count; of a hit the first MAX_OCCURRENCES occurrences."""
    owned = all_hits(places, nodes)
    hit = Window.partitionBy("doc_key", "ordinal")
    owned = owned.withColumn("occurrence_count", F.count(F.lit(1)).over(hit)).withColumn("place", F.row_number().over(hit.orderBy("start")).cast("long"))
    return owned.where(F.col("place") <= MAX_OCCURRENCES)


def context_windows(hits: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """Lines around hits, each once: doc_key, window, node, line_no, text, matched, columns.

    hits: doc_key, ordinal, node, start_line, end_line, columns (array of what is shown of a matched line).  Windows of n lines around
    neighbouring hits of one owner that touch or overlap are one; columns are sorted and each is named once.
    """
    order = Window.partitionBy("doc_key").orderBy("ordinal")
    around = hits.withColumn("lo", F.greatest(F.col("start_line") - n, F.lit(1))).withColumn("hi", F.col("end_line") + n)
    around = around.withColumn("run", F.sum(F.when(F.lag("node").over(order).eqNullSafe(F.col("node")) & F.lag("ordinal").over(order).isNotNull(), 0).otherwise(1)).over(order))
    # within a run of one owner the greatest end so far tells whether a window still reaches the next hit
    reach = F.max("hi").over(Window.partitionBy("doc_key", "run").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    around = around.withColumn("_new", F.when(F.col("lo") <= reach + 1, 0).otherwise(1)).withColumn("window", F.sum("_new").over(order).cast("long"))
    shown = around.groupBy("doc_key", "window").agg(F.first("node").alias("node"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    shown = shown.select("doc_key", "window", "node", F.explode(F.sequence("lo", "hi")).alias("line_no"))
    own = around.select("doc_key", "window", "columns", F.explode(F.sequence("start_line", "end_line")).alias("line_no"))
    own = own.groupBy("doc_key", "window", "line_no").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("columns")))).alias("columns"))
    out = shown.join(lines.select("doc_key", "line_no", "text"), ["doc_key", "line_no"]).join(own, ["doc_key", "window", "line_no"], "left")
    return out.select("doc_key", "window", "node", "line_no", "text", F.col("columns").isNotNull().alias("matched"), "columns")
