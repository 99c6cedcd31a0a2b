"""Choosing one document for a name, by phase, origin, candidate and exactness in one window."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import component_suffix
from docloom.operators.catalog import section_rank
from docloom.operators.aliases import alias_targets
from docloom.schema import RequestError

SECTION = r"^(?:[0-9][A-Za-z0-9]{0,15}|l|n)$"
TLDR_SECTION = r"^[18](?:[A-Za-z].*)?$"
REFERENCE_NAME = r"^[A-Za-z0-9._+:-]{1,256}$"


class Policy(Enum):
    COMBINED, MANUAL_ONLY, TLDR_ONLY = "combined", "manual-only", "tldr-only"


def plan(policy: Policy, has_section: bool) -> tuple[str, str]:
    """(document mode, tldr mode) of a named request."""
    if policy is Policy.TLDR_ONLY:
        if has_section:
            raise RequestError("TldrManualSection", "a quick reference has no manual section")
        return "none", "required"
    if policy is Policy.MANUAL_ONLY or has_section:
        return "manual", "none" if policy is Policy.MANUAL_ONLY else "optional"
    return "any", "optional"


# Page folders of quick references, in the order in which they are tried, and Windows' command suffixes.
TLDR_PLATFORMS = ("common", "linux", "osx", "macos", "windows", "android", "freebsd", "openbsd", "netbsd", "sunos", "cisco-ios", "dos")
HOST_PLATFORMS = {"linux": ("linux",), "macos": ("osx", "macos"), "windows": ("windows",)}
COMMAND_SUFFIXES = ".COM;.EXE;.BAT;.CMD"


def tldr_platforms(host: str) -> list[str]:
    """The host's own folders first, then all others."""
    return list(dict.fromkeys((*HOST_PLATFORMS[host], *TLDR_PLATFORMS)))


def tldr_languages(environment: dict[str, str]) -> list[str]:
    """Languages by preference, region before language, English last; LANGUAGE counts only where LANG names a language."""
    lang = environment.get("LANG")
    wanted = [] if lang in (None, "C", "POSIX") else [*environment.get("LANGUAGE", "").split(":"), lang]
    names = [w.split(".")[0].replace("-", "_") for w in wanted]
    both = [x for n in names if n not in ("", "C", "POSIX") for x in (n, n.split("_")[0])]
    return list(dict.fromkeys([*both, "en"]))


def command_suffixes(pathext: str | None = None) -> list[str]:
    """Suffixes of a PATHEXT, each with its dot, whatever its case once; the usual ones if it is blank."""
    given = pathext if pathext and pathext.strip() else COMMAND_SUFFIXES
    out: dict[str, str] = {}
    for suffix in map(str.strip, given.split(";")):
        if suffix and "/" not in suffix and "\\" not in suffix:
            dotted = suffix if suffix.startswith(".") else f".{suffix}"
            out.setdefault(dotted.lower(), dotted)
    return list(out.values())


def host_names(names: DataFrame, suffixes: list[str]) -> DataFrame:
    """Rows (selector, name) with all spellings by order, cand_ord: the name itself, then with each suffix if it has none of its own."""
    own = F.col("name").rlike(r"[^/\\]\.[^./\\]*$") & ~F.col("name").rlike(r"(^|[/\\])\.\.$")
    more = F.transform(F.array(*map(F.lit, suffixes)).cast("array<string>"), lambda x: F.concat("name", x))
    return names.select("selector", F.posexplode(F.when(own, F.array("name")).otherwise(F.concat(F.array("name"), more))).alias("cand_ord", "name"))


def is_manual_section(value: Column) -> Column:
    return value.rlike(SECTION)


def split_reference(value: Column) -> Column:
    """`name(section)` as a struct; null otherwise."""
    form = r"^([A-Za-z0-9._+:-]{1,256})\(([0-9][A-Za-z0-9]{0,15}|l|n)\)$"
    return F.when(value.rlike(form), F.struct(F.regexp_extract(value, form, 1).alias("name"), F.regexp_extract(value, form, 2).alias("section")))


def candidates(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """All rows that could answer a selector: names has selector, name, cand_ord (spellings in order)."""
    markdown = catalog.where("kind = 'markdown'").alias("c")
    n = names.alias("n")
    # equality on the last component first: a hash join, not all pairs
    last = F.element_at(F.split(F.col("c.logical_path"), "/"), -1) == F.element_at(F.split(F.col("n.name"), "/"), -1)
    found = markdown.join(n, last & component_suffix(F.col("c.logical_path"), F.col("n.name"))).select("n.selector", "n.cand_ord", "c.*", (F.col("c.logical_path") == F.col("n.name")).alias("is_exact"))
    manual = catalog.where("kind = 'manual'").alias("c").join(n, F.col("c.name") == F.col("n.name")).select("n.selector", "n.cand_ord", "c.*", F.lit(True).alias("is_exact"))
    return found.unionByName(manual)


def ranked(found: DataFrame) -> DataFrame:
    """Candidates with their place; those at place 1 answer the selector, more than one is ambiguous."""
    phase = F.when(F.col("kind") == "manual", 1).when((F.col("origin") == "documents") | (F.col("source_priority") > 0), 0).otherwise(2)
    order = Window.partitionBy("selector").orderBy(
        phase, F.when(F.col("origin") == "documents", 0).otherwise(1), F.col("source_priority").desc_nulls_last(), F.col("source_name").asc_nulls_first(), "cand_ord",
        F.col("is_exact").desc(), F.when(F.col("kind") == "manual", section_rank(F.col("manual_section"))).otherwise(F.lit(0)),
    )
    return found.withColumn("phase", phase.cast("long")).withColumn("place", F.dense_rank().over(order).cast("long"))


def resolve(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """One row a selector: winner (catalog path) or null with the choices, and whether it is ambiguous."""
    best = ranked(candidates(catalog, names)).where("place = 1").groupBy("selector").agg(F.array_sort(F.collect_set("catalog_path")).alias("choices"))
    return (
        names.select("selector").distinct().join(best, "selector", "left")
        .select("selector", F.coalesce(F.size("choices") > 1, F.lit(False)).alias("ambiguous"), F.when(F.size("choices") == 1, F.col("choices")[0]).alias("winner"), F.coalesce(F.size("choices"), F.lit(0)).cast("long").alias("n_choices"))
    )


def resolve_in_source(catalog: DataFrame, source: str, names: DataFrame) -> DataFrame:
    """An explicit source passes over personal documents and manuals."""
    return resolve(catalog.where((F.col("kind") == "markdown") & (F.col("source_name") == source)), names)


def locate_manual(catalog: DataFrame, name: str, section: str | None = None) -> DataFrame:
    pages = catalog.where((F.col("kind") == "manual") & (F.col("name") == name))
    pages = pages if section is None else pages.where(F.col("manual_section") == section)
    return pages.orderBy(section_rank(F.col("manual_section")), "manual_section").limit(1)


def attach_tldr(documents: DataFrame, tldr: DataFrame) -> DataFrame:
    """Quick references join only commands: manual sections of the families 1 and 8, and Markdown."""
    topic = tldr.withColumnRenamed("topic", "_topic")
    fits = (F.col("name") == F.col("_topic")) & ((F.col("kind") == "markdown") | F.col("manual_section").rlike(TLDR_SECTION))
    return documents.join(topic, fits, "left")


def tldr_page(cached: DataFrame, topic: str, platforms: list[str], languages: list[str]) -> DataFrame:
    """The first cached page of a topic by platform, then language, then cache, then folder."""
    normal = "-".join(topic.strip().lower().split())
    if not normal or "/" in normal or "\\" in normal or normal in (".", ".."):
        raise RequestError("TldrNotFound", f"not a page name: {topic!r}")
    return tldr_pages(cached.where(F.col("topic") == normal), platforms, languages)


def tldr_pages(cached: DataFrame, platforms: list[str], languages: list[str]) -> DataFrame:
    """The first cached page of every topic, by one aggregate with partial results; other platforms and languages answer nothing."""
    rank = lambda column, values: F.nullif(F.array_position(F.array(*map(F.lit, values)), F.col(column)), F.lit(0))
    rows = cached.select(F.struct(*[cached[c] for c in cached.columns]).alias("_page"), "topic", F.struct(rank("platform", platforms).alias("p"), rank("language", languages).alias("l"), "cache_ord", "dir_ord").alias("_at"))
    best = rows.where("_at.p IS NOT NULL AND _at.l IS NOT NULL").groupBy("topic").agg(F.min_by("_page", "_at").alias("_page"))
    return best.select(*[F.col("_page").getField(c).alias(c) for c in cached.columns])


def alias_chain(edges: DataFrame) -> DataFrame:
    """page, target, hops of the pages whose alias chain (page, target) ends well."""
    nodes = edges.select(F.col("page").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()
    found = alias_targets(nodes, edges.select(F.col("page").alias("node"), F.col("target").alias("to")))
    return found.where("status = 'found' AND hops > 0").select(F.col("node").alias("page"), "target", "hops")
