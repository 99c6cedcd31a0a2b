"""Repair of conversations' structure by cheapest edits, each distinct signature solved once.

Turns are put in order once, by equal ranges of (conversation, turn, role, text's hash), so a conversation of any
length lies in as many ranges as it needs; its rows are then named by their places in that order. A row becomes
one letter: its role's initial and whether it is sound, truncated or to be deleted (blank, or role and text seen earlier).  Blocks of up to
BLOCK neighbouring letters of a conversation are its signatures. Most conversations are one block; all that look alike
share one signature, and a solver sees every distinct one once.

The solver is a memoised recursion over (place, state of the grammar `(s?(ua)+)?`, inserts made here). In each state every edit has
one outcome, so at equal cost the lesser initial decides, and the cheapest edits in a block depend on the rest of the conversation
only through the least cost from each of four states. Blocks of long conversations are therefore solved from all states to all
states first, those costs are carried from the last block to the first, and then from the first to the last the state.
Audits are joined back to the blocks, and edits to the rows by their places.

What a conversation's blocks are gathered in is BLOCK times shorter than the audit, which is one value a conversation. The
hash of a whole conversation is sequential; its rows are streamed through it in order, never gathered.

Defined cases: null roles and texts are one space, and null ids and turns are one in the damage key; a null conv_id is a
conversation; null turns come first and have no part in gaps; rows of one turn are in order of role, then of the text's MD5; equal rows stand together, the first
is the one seen earlier; a role that does not begin with s, u or a (an empty one too) can't be kept, and is illegal beside any; very long texts are
only trimmed, hashed and streamed; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.llm.common import materialize

#: Rows of one signature.
BLOCK = 256
#: Plans of signatures of over one in so many blocks are sent to all tasks.
HEAVY = 1_000
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the grammar: at the start, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
_ENDS, _NEVER = (START, ASSISTANT), 1 << 40
#: Where a kept initial leads, and which one a rerole or an insert takes.
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_WANTED = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: Letters of a signature by initial (s, u, a, other): sound, truncated, to be deleted.
SOUND, CUT, GONE = "suao", "SUAO", "xyz_"
_LEGAL = frozenset(("su", "ua", "au"))


def initial(letter: str) -> str:
    """The role's initial behind a letter of a signature."""
    for kind in (SOUND, CUT, GONE):
        if letter in kind:
            return SOUND[kind.index(letter)]
    raise ValueError(letter)


def illegal_pairs(signature: str) -> int:
    initials = [initial(x) for x in signature]
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))


class Solver:
    """Cheapest edits of one signature; ends has the cost from each state after it, None at the end of a conversation."""

    def __init__(self, signature: str, ends: tuple[int, ...] | None) -> None:
        self.signature, self.ends, self._known = signature, ends, {}
        # no cheapest edits insert more than three turns at one place: a fourth would come to a state that was passed
        self.most = 3
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * (len(signature) + 100)))

    def options(self, at: int, state: int, made: int) -> list[tuple[str, int, tuple[int, int, int], str | None]]:
        """Edits in order of their initials: initial, cost, where it leads, the role it gives."""
        (role, to), found = _WANTED[state], []
        letter = self.signature[at] if at < len(self.signature) else None
        if letter is not None:
            found.append(("D", DELETE, (at + 1, state, 0), None))
        if made < self.most and (letter is not None or self.ends is None):
            found.append(("I", INSERT, (at, to, made + 1), role))
        if letter is not None and letter not in GONE:
            stays = TRUNCATED if letter in CUT else 0
            kept = _NEXT.get((state, initial(letter)))
            if kept is not None:
                found.append(("K", stays, (at + 1, kept, 0), None))
            found.append(("R", stays + REROLE, (at + 1, to, 0), role))
        return found

    def cost(self, at: int, state: int, made: int = 0) -> int:
        key = (at, state, made)
        if key not in self._known:
            least = _NEVER
            if at == len(self.signature):
                least = (0 if state in _ENDS else _NEVER) if self.ends is None else self.ends[state]
            for _, cost, (to, then, again), _ in self.options(at, state, made):
                left = self.cost(to, then, again)
                least = min(least, cost + left)
            self._known[key] = min(least, _NEVER)
        return self._known[key]

    def edits(self, state: int) -> tuple[str, list[tuple[int, str, str | None]], int]:
        """Audit, (row or -1, edit, role) one by one, and the state at the end, of the cheapest edits from a state; ties by initials."""
        at, made, audit, steps = 0, 0, [], []
        while True:
            left = self.cost(at, state, made)
            if at == len(self.signature) and (self.ends is not None or (state in _ENDS and left == 0)):
                return "".join(audit), steps, state
            for edit, cost, then, role in self.options(at, state, made):
                if cost + self.cost(*then) == left:
                    break
            audit.append(edit)
            steps.append((-1 if edit == "I" else at, edit, role))
            at, state, made = then


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the test damage of the contract, by a checksum of conversation and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("_d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "_d", times.alias("_copy")).drop("_d", "_copy")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with place: neighbours of a conversation's order differ by one within a range; written."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    keyed = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text")).withColumn("_hash", F.md5("text")).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("_hash").asc(), F.col("_row").asc()]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return materialize(dealt.drop("_hash", "_row"), "turns")


def faults(ordered: DataFrame) -> DataFrame:
    """conv_id, turn, place, block, fault (blank, duplicate, truncated or null) and letter of every row."""
    trimmed = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    marked = ordered.select("conv_id", "turn", "place", "role", F.md5("text").alias("_hash"), F.right(trimmed, F.lit(1)).alias("_last"))
    # of equal turns only the first counts; equal rows are summed up before they move
    first = marked.groupBy("conv_id", "role", "_hash").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("_first"))
    fault = F.when(F.col("_last") == "", "blank").when(F.col("_first").isNull(), "duplicate").when(~F.col("_last").isin(".", "!", "?"), "truncated")
    start = F.substring("role", 1, 1)
    kind = F.when(start.isin("s", "u", "a"), F.instr(F.lit("sua"), start)).otherwise(F.lit(4))
    letters = F.when(F.col("fault").isin("blank", "duplicate"), F.lit(GONE)).when(F.col("fault") == "truncated", F.lit(CUT)).otherwise(F.lit(SOUND))
    joined = marked.join(first, "place", "left").withColumn("fault", fault)
    return joined.select("conv_id", "turn", "place", F.expr(f"place div {BLOCK}").alias("block"), "fault", F.substring(letters, kind, F.lit(1)).alias("letter"))


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From every state to every state: the least cost over a signature, row by row of the start's state."""
    for batch in batches:
        out = []
        for signature in batch.column(0).to_pylist():
            to = [Solver(signature, tuple(0 if q == end else _NEVER for q in range(4))) for end in range(4)]
            out.append([to[end].cost(0, start) for start in range(4) for end in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["signature", "costs"])


_PLAN = "struct<audit:string,cost:bigint,stop:int,steps:array<struct<row:int,edit:string,role:string>>>"
_PLAN_TYPE = pa.struct([("audit", pa.string()), ("cost", pa.int64()), ("stop", pa.int32()), ("steps", pa.list_(pa.struct([("row", pa.int32()), ("edit", pa.string()), ("role", pa.string())])))])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The plan of a signature from every state from which it is asked."""
    for batch in batches:
        plans, pairs = [], []
        for signature, ends, whole in zip(*(batch.column(n).to_pylist() for n in ("signature", "ends", "whole"))):
            solver = Solver(signature, None if ends is None else tuple(ends))
            of = []
            for start in (START,) if whole else range(4):
                cost = solver.cost(0, start)
                if cost >= _NEVER:
                    of.append(None)
                    continue
                audit, steps, stop = solver.edits(start)
                of.append({"audit": audit, "cost": cost, "stop": stop, "steps": [dict(zip(("row", "edit", "role"), s)) for s in steps]})
            plans.append(of)
            pairs.append(illegal_pairs(signature))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("signature", "ends", "whole")), pa.array(plans, pa.list_(_PLAN_TYPE)), pa.array(pairs, pa.int64())], ["signature", "ends", "whole", "plans", "illegal"]
        )


def _after(blocks: DataFrame) -> DataFrame:
    """(conv, block, ends) of the blocks of conversations that have several: the least cost from each state at a block's end, null at the last one's."""
    matrices = blocks.select("signature").distinct().mapInArrow(_costs, "signature string, costs array<bigint>")
    listed = blocks.join(matrices, "signature").groupBy("conv").agg(F.reverse(F.array_sort(F.collect_list(F.struct("block", "costs")))).alias("b"))
    # a conversation's end: what it still takes to end well from each state
    final = "array(0L, 4L, 2L, 0L)"
    step = "transform(sequence(0, 3), s -> array_min(transform(sequence(0, 3), e -> x.costs[4 * s + e] + acc[size(acc) - 1][e])))"
    ends = F.expr(f"aggregate(slice(b, 1, size(b) - 1), array({final}), (acc, x) -> concat(acc, array({step})))")
    least = F.expr("transform(ends, e -> transform(e, v -> v - array_min(e)))")
    each = listed.withColumn("ends", ends).withColumn("ends", least).select("conv", F.posexplode(F.arrays_zip("b", "ends")).alias("k", "z"))
    return each.select("conv", F.col("z.b.block").alias("block"), F.when(F.col("k") > 0, F.col("z.ends")).alias("ends"))


def solve(faulted: DataFrame) -> DataFrame:
    """One row a block: conv (struct of conv_id), block, first (place), plan of its edits, illegal; written."""
    letters = faulted.groupBy(F.struct("conv_id").alias("conv"), "block").agg(F.array_sort(F.collect_list(F.struct("place", "letter"))).alias("rows"))  # BLOCK rows at most
    blocks = letters.select("conv", "block", F.col("rows")[0]["place"].alias("first"), F.array_join(F.transform("rows", lambda x: x["letter"]), "").alias("signature"))
    blocks = materialize(blocks, "signatures")
    many = blocks.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv")
    split = materialize(_after(blocks.join(many, "conv", "left_semi")), "ends")
    asked = blocks.join(split.select("conv", "block", "ends", F.lit(False).alias("_one")), ["conv", "block"], "left").withColumn("whole", F.col("_one").isNull()).drop("_one")
    plans = asked.select("signature", "ends", "whole").distinct().mapInArrow(_solved, f"signature string, ends array<bigint>, whole boolean, plans array<{_PLAN}>, illegal bigint")
    plans = plans.select(F.xxhash64("signature", "ends", "whole").alias("h"), F.struct("signature", "ends", "whole").alias("key"), "plans", "illegal")
    mine = asked.withColumn("h", F.xxhash64("signature", "ends", "whole")).withColumn("key", F.struct("signature", "ends", "whole")).drop("ends", "whole")
    # signatures that very many conversations share meet their plans in a broadcast: fewer than HEAVY are asked by over one block in HEAVY
    return materialize(_chosen(_met(mine, plans)), "plans")


def _met(asked: DataFrame, plans: DataFrame) -> DataFrame:
    """asked with the plans of its keys."""
    plans = materialize(plans, "solutions")
    heavy = asked.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.lit(max(1, asked.count() // HEAVY))).select("h")
    heavy = materialize(heavy, "heavy")
    hot = asked.join(F.broadcast(plans.join(F.broadcast(heavy), "h", "left_semi")), ["h", "key"])
    rest = asked.join(F.broadcast(heavy), "h", "left_anti").join(plans, ["h", "key"])
    return hot.unionByName(rest.select(*hot.columns))


def _chosen(met: DataFrame) -> DataFrame:
    """Each block with the plan from the state in which it begins, carried from the first block to the last."""
    one = met.where("key.whole").select("conv", "block", "first", "signature", "illegal", F.col("plans")[0].alias("plan"))
    several = met.where("NOT key.whole")
    stops = several.select("conv", "block", F.transform("plans", lambda p: p["stop"]).alias("stops"))
    listed = stops.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "stops"))).alias("b"))
    states = F.expr("aggregate(slice(b, 1, size(b) - 1), array(0), (acc, x) -> concat(acc, array(x.stops[acc[size(acc) - 1]])))")
    begun = listed.withColumn("states", states).select("conv", F.expr("inline(transform(b, (x, i) -> named_struct('block', x.block, 'state', states[i])))"))
    chosen = several.join(begun, ["conv", "block"]).select("conv", "block", "first", "signature", "illegal", F.expr("plans[state]").alias("plan"))
    return one.unionByName(chosen)


def repaired_turns(ordered: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, block, step, turn, role, text, edit of the repaired conversations, in order of (block, step); inserted turns have no number and an empty text."""
    steps = plans.select("conv", "block", "first", F.posexplode("plan.steps").alias("step", "s")).where("s.edit <> 'D'")
    steps = steps.select("conv", "block", "step", F.when(F.col("s.row") >= 0, F.col("first") + F.col("s.row")).alias("place"), F.col("s.edit").alias("edit"), F.col("s.role").alias("new_role"))
    own = steps.where("place IS NOT NULL").join(ordered.select("place", "turn", "role", "text"), "place")
    kept = own.select("conv.conv_id", "block", "step", "turn", F.coalesce("new_role", "role").alias("role"), "text", "edit")
    put = steps.where("place IS NULL").select("conv.conv_id", "block", "step", F.lit(None).cast(ordered.schema["turn"].dataType).alias("turn"), F.col("new_role").alias("role"), F.lit("").alias("text"), "edit")
    return kept.unionByName(put)


def _hashed(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done = (), None, []
        for batch in batches:
            for key, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text")):
                if (key,) != conv:
                    if state is not None:
                        done.append((conv[0], state.hexdigest()))
                    conv, state = (key,), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(role.encode() + b":")
                state.update(text.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], ["conv_id", "repaired_sha256"])
                done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv[0]], kind), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    return run


def conversation_hashes(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of role:text, joined by line breaks; each conversation is streamed in order."""
    rows = repaired.select("conv_id", "block", "step", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "block", "step")
    field = repaired.schema["conv_id"].dataType
    return rows.select("conv_id", "role", "text").mapInArrow(_hashed(to_arrow_type(field)), f"conv_id {field.simpleString()}, repaired_sha256 string")


def statistics(faulted: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated; equal turns are summed up first."""
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    turns = faulted.groupBy("conv_id", "turn").agg(count("blank"), count("duplicate"), count("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    return turns.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")])


def audits(plans: DataFrame) -> DataFrame:
    """conv_id, illegal, cost, audit of each conversation."""
    block = F.struct("block", F.col("plan.audit").alias("audit"), F.col("signature").substr(1, 1).alias("a"), F.expr("right(signature, 1)").alias("z"), "illegal", _spent().alias("cost"))
    listed = plans.groupBy("conv").agg(F.array_sort(F.collect_list(block)).alias("b"))
    first = {x: SOUND[i] for kind in (SOUND, CUT, GONE) for i, x in enumerate(kind)}
    role = lambda c: f"translate({c}, '{''.join(first)}', '{''.join(first.values())}')"
    between = F.expr(f"aggregate(transform(slice(b, 2, size(b)), (x, i) -> CASE WHEN concat({role('b[i].z')}, {role('x.a')}) IN ('su', 'ua', 'au') THEN 0L ELSE 1L END), 0L, (s, x) -> s + x)")
    return listed.select(
        "conv.conv_id", (F.expr("aggregate(b, 0L, (s, x) -> s + x.illegal)") + between).alias("illegal"), F.expr("aggregate(b, 0L, (s, x) -> s + x.cost)").alias("cost"),
        F.array_join(F.transform("b", lambda x: x["audit"]), "").alias("audit"),
    )


def _spent():
    """Cost of a block's own edits."""
    return F.expr(
        f"aggregate(plan.steps, 0L, (s, x) -> s + CASE x.edit WHEN 'D' THEN {DELETE}L WHEN 'I' THEN {INSERT}L WHEN 'R' THEN {REROLE}L ELSE 0L END"
        f" + CASE WHEN x.edit IN ('K', 'R') AND substring(signature, x.row + 1, 1) IN ('S', 'U', 'A', 'O') THEN {TRUNCATED}L ELSE 0L END)"
    )


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired): one row a conversation of turns, and the repaired turns as of :func:`repaired_turns`."""
    ordered = ordered_turns(turns)
    faulted = materialize(faults(ordered), "faults")
    plans = solve(faulted)
    repaired = repaired_turns(ordered, plans)
    columns = [F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")]
    parts = statistics(faulted).unionByName(audits(plans), allowMissingColumns=True).unionByName(conversation_hashes(repaired), allowMissingColumns=True)
    return parts.groupBy("conv_id").agg(*columns), repaired


def audit_conversations(conversations: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """The report over all conversations of a table, also those of which no turn is left; turns are its own unless given."""
    report, _ = repair(conversations if turns is None else turns)
    every = conversations.select("conv_id").distinct().withColumn("_own", F.lit(True)).unionByName(report.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    zeros = [F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return every.groupBy("conv_id").agg(*zeros, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256"))
