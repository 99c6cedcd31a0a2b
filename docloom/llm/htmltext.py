"""Main text of web pages by differencing pages with near urls.

A page becomes lines: the text of its blocks, each with its slot (the elements around it, with their classes)
and what the markup says of it.  The distinct pages of a host are put in order of their paths and
each is paired with the neighbour whose path starts most alike.  Two longest common
subsequences align a pair: one of the lines' texts, one of the runs of equal slots.  What they share is the site's:

* where a page has an article, a line outside of it goes if its text or its slot is shared; elsewhere a line goes if
  its text is, as pages keep their main text in like slots (and articles may quote the same passage, so theirs stay);
* a line that class or role words call an advert, a newsletter and so on goes if its slot or its text is shared, also in an article;
* the unshared lines say where the main text lies: in the page's article, or, if more than TEASER times as much
  unshared text lies outside of it, outside (the articles are then teasers).

What the alignment can't see is left to the page's own words (:func:`worded`): a page without a neighbour keeps its article alone,
a line outside of an article that is called an aside goes, as an advert may stand on one page only, and the class
words of NAMED (adverts, notices) hold inside articles too.  Elements that HTML defines as menus, footers, sidebars, forms and
the like, the roles that stand for them, and containers of readers' comments, by class or id, go on every page, as those texts
differ from page to page on many sites.  A neighbour that shares all of a page's unmarked lines is a copy
with another menu and decides nothing.

Hosts are cut into ranges of bounded size, with the pages at either side of a cut, so a host
with a third of all pages is no one task's.  Pages of a host with the same lines are one page there, so
copies cost one comparison and never count as neighbours.  Only hashes are dealt out for that; texts
move once, compressed, to meet the decisions.

Defined cases: null html has no lines and an empty text; a null url has an empty host and path; a page
whose host has no other page shares nothing; pages with equal paths are neighbours in an
order of their lines' hashes, the same for the same input; repeated rows are rows of their own with equal texts; a very long
page is one row of its task and is aligned in memory linear in its lines; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import drop_scratch, materialize
from docloom.llm.urlfilter import host_of, path_of

#: Distinct pages of one range.
PAGES_A_RANGE = 5_000
#: Articles are teasers if more than this many times their text is unshared and outside of them.
TEASER = 3
#: Bits that one alignment may hold at once; longer ones are split.
BITS_AT_ONCE = 64_000_000
#: Elements whose text is never shown.
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video textarea select datalist".split())
#: Elements that are no part of an article.
ASIDE = frozenset("nav footer aside form menu dialog button fieldset".split())
#: Roles that stand for such elements.
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in class or id of elements that may be no part of an article.
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies dialog footer header login menu "
    "modal nav navbar navigation newsletter notice notices pagination popup promo related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Class words that hold in an article without a neighbour: adverts and notices.
NAMED_WORDS = frozenset("ad ads advert advertisement adverts alert notice notices sponsored".split())
#: Words in class or id of containers of readers' comments.
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
#: Parts of words that tell of a page's state and name no container.
STATE_WORDS = frozenset("closed has no open with".split())
#: Elements that may contain comments.
CONTAINERS = frozenset("article div dl li ol section table ul".split())
#: Elements that hold an article.
ARTICLE = frozenset("article main".split())
#: Elements within a line; all others begin and end blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open element of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Block elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in UNSEEN}

#: Marks of lines: none; called an aside by words; inside an element that is one for sure; called an advert or a notice by a whole class word.
PLAIN, CALLED, SURE, NAMED = 0, 1, 2, 3


class Line(NamedTuple):
    text: str
    mark: int
    inside: bool  # an article
    slot: str


class _Open(NamedTuple):
    name: str
    asides: int
    called: int
    named: int
    articles: int
    place: int  # of its tag
    slot: str


def _names(attributes: str) -> tuple[list[str], list[str], list[str]]:
    """Words of class, id and role."""
    out: dict[str, list[str]] = {"class": [], "id": [], "role": []}
    if "=" in attributes:
        for kind, *value in _NAMED.findall(attributes.lower()):
            out[kind] += "".join(value).split()
    return out["class"], out["id"], out["role"]


def _parts(word: str) -> list[str]:
    return [x for x in re.split(r"[^a-z0-9]+", word) if x]


def _is_called(classes: list[str], ids: list[str], inside: bool) -> bool:
    if inside:  # an id there names a section, and a word with others than these is its own
        return any(ASIDE_WORDS.issuperset(_parts(w) or [w]) for w in classes)
    return any(part in ASIDE_WORDS for w in (*classes, *ids) for part in _parts(w))


def _holds_comments(name: str, classes: list[str], ids: list[str]) -> bool:
    found = (set(_parts(w)) for w in (*classes, *ids))
    return name in CONTAINERS and any(not COMMENT_WORDS.isdisjoint(parts) and STATE_WORDS.isdisjoint(parts) for parts in found)


def lines_of(page: str | None) -> list[Line]:
    """Lines in page order; words, and a form, that would hide all of a page's articles do not count on them and what contains them."""
    out, around = _lines(page, frozenset())
    if around and not any(x.inside and x.mark == PLAIN for x in out):
        out, _ = _lines(page, around)
    return out


def _lines(page: str | None, wordless: frozenset[int]) -> tuple[list[Line], frozenset[int]]:
    """Lines, and places of the tags that open an article or what contains one; words in the tags at the places wordless do not count."""
    around: set[int] = set()
    out: list[Line] = []
    held: list[str] = []
    outside = _Open("", 0, 0, 0, 0, -1, "")
    stack: list[_Open] = []
    top, source = outside, page or ""

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(Line(text, SURE if top.asides else NAMED if top.named else CALLED if top.called else PLAIN, top.articles > 0, top.slot))

    at = 0
    while (tag := _TAG.search(source, at)) is not None:
        held.append(source[at : tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
        if name not in INLINE:
            flush()
        elif name == "br":
            held.append(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            top = stack[-1] if stack else outside
            continue
        if name in UNSEEN and not attributes.endswith("/"):
            end = _ENDS[name].search(source, at)
            at = end.end() if end else len(source)
            continue
        if name in VOID:
            continue
        if name in CLOSES or name in ENDS_P:
            ended = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name in ended:
                    del stack[k:]
                    break
                if stack[k].name not in INLINE and stack[k].name != "p":
                    break
            top = stack[-1] if stack else outside
        words, ids, roles = _names(attributes)
        worded = name not in ("html", "body") and tag.start() not in wordless
        aside = name in ASIDE and (name != "form" or tag.start() not in wordless) or (name == "header" and not top.articles)
        aside = aside or worded and (not ASIDE_ROLES.isdisjoint(roles) or _holds_comments(name, words, ids))
        called = worded and not aside and _is_called(words, ids, top.articles > 0)
        named = called and not NAMED_WORDS.isdisjoint(words)
        if name in ARTICLE:
            around.update(x.place for x in stack)
            around.add(tag.start())
        article = name in ARTICLE and not (top.asides or top.called or aside or called)
        slot = top.slot if name in INLINE else f"{top.slot}/{name}" + "".join(f".{w}" for w in sorted({re.sub(r'[0-9]+', '', w) for w in (*words, *roles)}))
        top = _Open(name, top.asides + aside, top.called + called, top.named + named, top.articles + article, tag.start(), slot)
        stack.append(top)
    held.append(source[at:])
    flush()
    return out, frozenset(around)


def _states(x: list[int], y: list[int]) -> Iterator[int]:
    """After each element of x: bit j is clear if y[: j + 1] has a longer common subsequence with it than y[:j]."""
    places: dict[int, int] = {}
    for j, v in enumerate(y):
        places[v] = places.get(v, 0) | 1 << j
    state = whole = (1 << len(y)) - 1
    for v in x:
        met = state & places.get(v, 0)
        state = ((state + met) | (state - met)) & whole
        yield state


def _scores(x: list[int], y: list[int]) -> np.ndarray:
    """The length of a longest common subsequence of x with each prefix of y."""
    state = (1 << len(y)) - 1
    for state in _states(x, y):
        pass
    bits = np.unpackbits(np.frombuffer(state.to_bytes((len(y) + 7) // 8 or 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def _aligned(x: list[int], y: list[int], first: int, out: list[int]) -> None:
    """Adds the indexes, from first on, of x in a longest common subsequence; long inputs are halved where their halves' scores fit best."""
    if not x or not y:
        return
    if len(x) > 1 and len(x) * len(y) > BITS_AT_ONCE:
        half = len(x) // 2
        cut = int(np.argmax(_scores(x[:half], y) + _scores(x[half:][::-1], y[::-1])[::-1]))
        _aligned(x[:half], y[:cut], first, out)
        _aligned(x[half:], y[cut:], first + half, out)
        return
    rows = [(1 << len(y)) - 1, *_states(x, y)]
    i, j = len(x), len(y)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i -= 1
            j -= 1
            out.append(first + i)


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Indexes of a in a longest common subsequence of both (bit-parallel, traced back)."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [*range(head), *range(len(a) - tail, len(a))]
    in_a, in_b = set(a[head : len(a) - tail]), set(b[head : len(b) - tail])
    x = [(i, v) for i, v in enumerate(a[head : len(a) - tail], head) if v in in_b]
    found: list[int] = []
    _aligned([v for _, v in x], [v for v in b[head : len(b) - tail] if v in in_a], 0, found)
    return sorted([*out, *(x[k][0] for k in found)])


def shared_slots(a: list[int], b: list[int]) -> list[int]:
    """Indexes of a whose runs of equal slots are in a longest common subsequence of both pages' runs."""
    starts = [i for i, v in enumerate(a) if not i or a[i - 1] != v]
    runs = shared_lines([a[i] for i in starts], [v for i, v in enumerate(b) if not i or b[i - 1] != v])
    stops = [*starts[1:], len(a)]
    return [i for k in runs for i in range(starts[k], stops[k])]


def kept_lines(hashes: list[int], slots: list[int], marks: list[int], sizes: list[int], near: list[tuple[list[int], list[int]]]) -> tuple[list[int], bool, bool]:
    """Indexes of the lines that stay by the alignment, whether the main text is in articles, and whether a neighbour decided.

    marks are the lines' marks, with 4 added inside an article; near has hashes and slots of the neighbours, the nearest first.
    """
    plain = [i for i, m in enumerate(marks) if not m & 3]
    inside = [i for i in plain if marks[i] & 4]
    texts: set[int] = set()
    places: set[int] = set()
    met = False
    for other, other_slots in near:
        shared = set(shared_lines(hashes, other))
        if all(i in shared for i in plain) and plain:
            continue  # a copy
        texts, places, met = shared, set(shared_slots(slots, other_slots)), True
        break
    own = [i for i in plain if not marks[i] & 4 and i not in texts]
    articles = bool(inside) and sum(sizes[i] for i in own) <= TEASER * sum(sizes[i] for i in inside)
    out = []
    for i, m in enumerate(marks):
        if m & 3 == SURE or inside and not articles and m & 4:
            continue
        if m & 3 == PLAIN:
            site = not m & 4 and (i in texts or articles and i in places)
        else:
            site = i in texts or i in places
        if not site:
            out.append(i)
    return out, articles, met


def worded(kept: list[int], marks: list[int], articles: bool, met: bool) -> list[int]:
    """Of the lines that the alignment left, those that stay by the page's own elements and words."""
    return [i for i in kept if marks[i] & 3 != NAMED and (marks[i] & 4 or marks[i] & 3 == PLAIN and (met or not articles))]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _key(host: str, hashes: list[int], slots: list[int], marks: list[int]) -> bytes:
    """Names pages of a host with the same lines."""
    return hashlib.blake2b(np.array([hashes, slots, marks], np.int64).tobytes() + host.encode(), digest_size=16).digest()


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each batch: the batch, its pages' lines, and by page the lines' hashes, slots, marks, and the page's key."""
    known: dict[str, int] = {}
    for batch in batches:
        pages = [lines_of(x.as_py()) for x in batch.column("_html")]
        if len(known) > 100_000:
            known.clear()
        hashes = [[_hash(x.text) for x in page] for page in pages]
        slots = [[known.get(x.slot) or known.setdefault(x.slot, _hash(x.slot)) for x in page] for page in pages]
        marks = [[x.mark + 4 * x.inside for x in page] for page in pages]
        yield batch, pages, hashes, slots, marks, [*map(_key, batch.column("host").to_pylist(), hashes, slots, marks)]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, pages, hashes, slots, marks, keys in _read(batches):
        yield _batch(
            {
                "key": pa.array(keys, pa.binary()),
                "host": batch.column("host"),
                "path": batch.column("path"),
                "hashes": pa.array(hashes, pa.list_(pa.int64())),
                "slots": pa.array(slots, pa.list_(pa.int64())),
                "marks": pa.array(marks, pa.list_(pa.int8())),
                "sizes": pa.array([[len(x.text) for x in page] for page in pages], pa.list_(pa.int32())),
            }
        )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=6)
    for batch, pages, _, _, _, keys in _read(batches):
        lines = [pack.compress("\n".join(x.text for x in page).encode()) for page in pages]
        yield _batch({"id": batch.column("id"), "page_url": batch.column("page_url"), "key": pa.array(keys, pa.binary()), "lines": pa.array(lines, pa.binary())})


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _paired(pages: pd.DataFrame) -> pd.DataFrame:
    """One range with its neighbours at either side: what stays of each page of its own."""
    pages = pages.sort_values(["host", "path", "key"], kind="stable")
    hosts, paths, keys, own = (pages[c].tolist() for c in ("host", "path", "key", "own"))
    hashes, slots, marks, sizes = (pages[c].tolist() for c in ("hashes", "slots", "marks", "sizes"))
    out = []
    for i in range(len(keys)):
        if own[i]:
            near = [k for k in (i - 1, i + 1) if 0 <= k < len(keys) and hosts[k] == hosts[i]]
            near.sort(key=lambda k: -_alike(paths[i], paths[k]))
            held, articles, met = kept_lines(list(hashes[i]), list(slots[i]), list(marks[i]), list(sizes[i]), [(list(hashes[k]), list(slots[k])) for k in near])
            open_lines = sum(m & 3 != SURE for m in marks[i])
            out.append((keys[i], worded(held, list(marks[i]), articles, met), open_lines - len(held) if met else 0))
    return pd.DataFrame({"key": pd.Series([k for k, _, _ in out], dtype=object), "kept": pd.Series([x for _, x, _ in out], dtype=object), "n_site": pd.Series([n for _, _, n in out], dtype="int64")})


def decisions(hashed: DataFrame) -> DataFrame:
    """key, kept (indexes of lines) and n_site of the distinct pages (key, host, path, hashes, slots, marks, sizes)."""
    page = F.struct("path", "hashes", "slots", "marks", "sizes")
    once = materialize(hashed.groupBy("key", "host").agg(F.min_by(page, "path").alias("p")).select("key", "host", "p.*"), "distinct-pages")
    n = max(1, -(-once.count() // PAGES_A_RANGE))
    ranged = materialize(once.repartitionByRange(n, "host", "path", "key").withColumn("part", F.spark_partition_id()), "page-ranges")
    drop_scratch(once)
    held, order = F.struct(*once.columns), F.struct("host", "path", "key")
    edges = ranged.groupBy("part").agg(F.min_by(held, order).alias("first"), F.max_by(held, order).alias("last"))
    # a range may be empty, so those beside each other are found from the numbers alone
    by_part = Window.orderBy("part")
    steps = ranged.select("part").distinct().select("part", F.lag("part").over(by_part).alias("prior"), F.lead("part").over(by_part).alias("next"))
    before = steps.join(edges.select(F.col("part").alias("prior"), "last"), "prior").select("last.*", "part")
    after = steps.join(edges.select(F.col("part").alias("next"), "first"), "next").select("first.*", "part")
    beside = before.unionByName(after).withColumn("own", F.lit(False))
    whole = ranged.withColumn("own", F.lit(True)).unionByName(beside)
    found = materialize(whole.groupBy("part").applyInPandas(_paired, "key binary, kept array<int>, n_site bigint"), "decisions")
    drop_scratch(ranged)
    return found


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for packed, kept in zip(batch.column("lines").to_pylist(), batch.column("kept").to_pylist()):
            lines = unpack.decompress(packed).decode().split("\n")
            out.append("\n\n".join([lines[i] for i in kept or ()]))
        yield _batch(
            {
                "id": batch.column("id"),
                "page_url": batch.column("page_url"),
                "text": pa.array(out, pa.string()),
                "n_chars": pa.array([len(t) for t in out], pa.int64()),
                "n_site": batch.column("n_site"),
            }
        )


def main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """id_col, url_col, text, n_chars, n_site (lines that went as a neighbour showed them to be the site's)."""
    held = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("page_url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("_html"))
    kinds = {f.name: f.dataType.simpleString() for f in held.schema}
    hashed = held.select("host", "path", "_html").mapInArrow(_hashed, "key binary, host string, path string, hashes array<bigint>, slots array<bigint>, marks array<tinyint>, sizes array<int>")
    found = decisions(hashed)
    # pages are read twice, which costs less than the texts would take on disk meanwhile; copies of a page
    # all meet one decision, and such a key is split by the adaptive join
    packed = held.select("id", "page_url", "host", "_html").mapInArrow(_packed, f"id {kinds['id']}, page_url {kinds['page_url']}, key binary, lines binary")
    met = packed.join(found, "key", "left").select("id", "page_url", "lines", "kept", "n_site")
    texts = met.mapInArrow(_texts, f"id {kinds['id']}, page_url {kinds['page_url']}, text string, n_chars bigint, n_site bigint")
    return texts.select(F.col("id").alias(id_col), F.col("page_url").alias(url_col), "text", "n_chars", "n_site")
