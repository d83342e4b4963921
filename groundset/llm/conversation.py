"""Conversation structure repair: weighted CYK parsing of the turns, with the cheapest edits of every span.

A repaired conversation's role initials read `(s?(ua)+)?`. The grammar is in Chomsky normal form: a nonterminal (q, r) derives the
spans of turns whose edits lead the pattern from state q to state r. Its rules are (q, r) -> (q, p) (p, r) for every p; a turn is a leaf (kept,
given another role, or deleted), and the insertions that lead from q to r derive the empty span; every leaf is closed under them on both
sides. A cell holds the least (cost, audit) of a span and a nonterminal. Any split of a span derives all that it derives, so one
split is enough: spans of 1, 2, 4, ... turns are combined bottom-up.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import merge_join, stored

#: Turns of a segment; a longer conversation is parsed in segments, whose cells are combined.
SEGMENT = 1 << 10
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: The pattern's states: nothing yet, a system turn, a user's turn, an assistant's turn; (state, role initial) to the next state.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)

_SPACE = " \t\n\x0b\x0c\r"
_CELLS = "array<struct<q:int,r:int,cost:long,audit:string>>"
_SOLVED = "cost long, audit string, plan array<struct<edit:string,at:int,role:string>>"


def _join(left: dict, right: dict) -> dict:
    """Cells of a span from those of its two parts: (cost, audit, state between them)."""
    found: dict = {}
    for (q, p), (cost, audit, _) in left.items():
        for r in range(4):
            other = right.get((p, r))
            if other is not None:
                cell = (cost + other[0], audit + other[1], p)
                if (q, r) not in found or cell < found[q, r]:
                    found[q, r] = cell
    return found


def _insertions() -> dict:
    """Cells of the empty span: the closure of single insertions."""
    none = {(q, q): (0, "", q) for q in range(4)}
    one = none | {(q, r): (INSERT, "I", q) for (q, role), r in STEPS.items() if role in ROLES}
    return _join(one, _join(one, one))


def _leaf(code: str) -> dict:
    """Cells of a turn. `code`: the role initial (o: no role of the pattern), upper case if truncated; x: it must go."""
    turn = {(q, q): (DELETE, "D", q) for q in range(4)}
    more = TRUNCATED if code.isupper() else 0
    for (q, role), r in STEPS.items() if code != "x" else ():
        options = [(KEEP + more, "K", q)] if role == code.lower() else []
        options += [(REROLE + more, "R", q)] if role in ROLES else []
        if options:
            turn[q, r] = min(options + ([turn[q, r]] if (q, r) in turn else []))
    return _join(_join(_insertions(), turn), _insertions())


_LEAVES = {code: _leaf(code) for code in "suaoSUAOx"}


def cells(codes: str) -> dict:
    """(cost, audit, state) by (state before, state after), of a span of at least one turn."""
    level = [_LEAVES[code] for code in codes]
    while len(level) > 1:
        level = [_join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def plan(codes: str, audit: str, state: int) -> list[dict]:
    """What an audit that begins in `state` writes, turn by turn: the edit, the turn it uses (none: inserted), the role it gives (none: the turn's own)."""
    written, at = [], 0
    for edit in audit:
        if edit != "D":
            role = "s" if edit == "K" and codes[at] in "sS" else "a" if state == 2 else "u"
            state = STEPS[state, role]
            written.append({"edit": edit, "at": None if edit == "I" else at, "role": None if edit == "K" else ROLES[role]})
        at += edit != "I"
    return written


def _solved(codes: pd.Series, enter: pd.Series, leave: pd.Series) -> pd.DataFrame:
    """The cheapest edits of a span between two states; leave -1: any state that may end a conversation."""
    rows = []
    for code, q, end in zip(codes, enter, leave):
        known = cells(code)
        cost, audit = min(known[q, r][:2] for r in (ENDS if end < 0 else (end,)) if (q, r) in known)
        rows.append((cost, audit, plan(code, audit, q)))
    return pd.DataFrame(rows, columns=["cost", "audit", "plan"])


def _cells(codes: pd.Series) -> pd.Series:
    return pd.Series([[{"q": q, "r": r, "cost": c[0], "audit": c[1]} for (q, r), c in cells(code).items()] for code in codes])


def _path(segments: pd.DataFrame) -> pd.DataFrame:
    """The states in which each segment of one conversation is entered and left."""
    segments = segments.sort_values("segment")
    level = [{(c["q"], c["r"]): (c["cost"], c["audit"], None) for c in own} for own in segments["cells"]]
    levels = [level]
    while len(level) > 1:
        level = [_join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        levels.append(level)
    _, _, end = min((*level[0][0, r][:2], r) for r in ENDS if (0, r) in level[0])
    states = [(0, end)]
    for below, above in zip(levels[-2::-1], levels[:0:-1]):
        states = [pair for i, (q, r) in enumerate(states) for pair in (((q, above[i][q, r][2]), (above[i][q, r][2], r)) if 2 * i + 1 < len(below) else ((q, r),))]
    return segments[["conv", "segment"]].assign(enter=[q for q, _ in states], leave=[r for _, r in states])


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def segments(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv, segment, turns): the turns of each conversation in order, with their faults, in arrays of at most `segment`.

    `turns` has conv, turn, role and text, no role or text null. A conversation of at most `segment` turns is sorted where its turns meet. The turns of a
    longer one are range-partitioned; the first of equal ones is found by a grouped minimum, so no task holds a whole conversation.
    """
    sizes = stored(turns.groupBy("conv").agg(F.count("*").alias("size")).where(F.col("size") > segment).select(F.col("conv").alias("large")))
    by_turn = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    short = turns.join(sizes, _same("conv", "large"), "left_anti").repartition("conv")
    short = short.withColumn("again", F.row_number().over(W.partitionBy("conv", "role", "text").orderBy(by_turn[0])) > 1).withColumn("at", F.lit(0).cast("long")).withColumn("segment", F.lit(0).cast("long"))
    made = [short]
    if not sizes.isEmpty():
        large = stored(turns.join(sizes, _same("conv", "large"), "left_semi").withColumn("row", F.monotonically_increasing_id()))
        place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")
        first = large.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("text").alias("t")).agg(F.min(place).alias("first"))
        large = merge_join(large, stored(first), _same("conv", "c") & _same("role", "r") & _same("text", "t")).withColumn("again", F.col("row") != F.col("first.row"))
        order = [F.col("conv"), *by_turn, F.col("again"), F.col("row")]
        large = large.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
        made.append(large.withColumn("segment", F.floor(F.col("at") / segment)).select(*short.columns))
    trimmed = F.rtrim(F.col("text"), F.lit(_SPACE))
    # the order of a struct's fields is the order of turns; nulls come first
    turn = F.struct("at", "turn", "role", "text", "again", F.when(trimmed == "", "blank").when(F.col("again"), "duplicate").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated").alias("fault"))
    parts = [part.groupBy("conv", "segment").agg(F.array_sort(F.collect_list(turn)).alias("turns")) for part in made]
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The cheapest repair of every conversation, a row for each of its segments of at most `segment` turns.

    Keeping a turn costs 0, giving it the role user or assistant 1, deleting it 2, which blank and repeated turns must be; an inserted
    user's or assistant's turn without text costs 5; a truncated turn that isn't deleted costs 5 more. Of equally cheap repairs, the one with the least
    audit counts. Returns (conv, segment, turns with their faults, cost, audit: the initials of the edits, repaired: array of
    (edit, role, text)).

    Turns are ordered by turn, nulls first, then role, then text. Null roles and texts count as empty. A null conversation is one
    conversation. Repeated rows are repeated turns. An empty table gives an empty result; other columns are not read. A long
    conversation's segments are parsed apart; what meets in one task is their cells, eleven times its audit, which is a value of the result.
    """
    turns = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = stored(segments(turns, segment))
    initial = lambda t: F.substring(t["role"], 1, 1)
    code = lambda t: F.when(t["fault"].isin("blank", "duplicate"), "x").otherwise(F.when(initial(t).isin("s", "u", "a"), F.when(t["fault"] == "truncated", F.upper(initial(t))).otherwise(initial(t))).otherwise(F.when(t["fault"] == "truncated", "O").otherwise("o")))
    parts = parts.withColumn("codes", F.array_join(F.transform("turns", code), ""))
    several = stored(parts.groupBy(F.col("conv").alias("c")).agg(F.count("*").alias("n")).where("n > 1").select("c"))
    if several.isEmpty():
        parts = parts.withColumns({"enter": F.lit(0), "leave": F.lit(-1)})
    else:
        cut = parts.join(several, _same("conv", "c"), "left_semi").select(F.col("conv").cast("string").alias("conv"), "segment", F.pandas_udf(_cells, _CELLS)("codes").alias("cells"))
        path = stored(cut.groupBy("conv").applyInPandas(_path, "conv string, segment long, enter int, leave int"))
        path = path.select(F.col("conv").cast(parts.schema["conv"].dataType).alias("c"), F.col("segment").alias("s"), "enter", "leave")
        parts = parts.join(path, _same("conv", "c") & _same("segment", "s"), "left").withColumns({"enter": F.coalesce("enter", F.lit(0)), "leave": F.coalesce("leave", F.lit(-1))})
    told = parts.withColumn("best", F.pandas_udf(_solved, _SOLVED)("codes", "enter", "leave"))
    written = lambda p: F.struct(p["edit"].alias("edit"), F.coalesce(p["role"], F.get("turns", p["at"])["role"]).alias("role"), F.coalesce(F.get("turns", p["at"])["text"], F.lit("")).alias("text"))
    return told.select("conv", "segment", "turns", "best.cost", "best.audit", F.transform("best.plan", written).alias("repaired"))


def report(repaired: DataFrame) -> DataFrame:
    """A row for each conversation of `repair`: gaps in the turn numbers, turns by first fault, illegal neighbours, cost and audit."""
    numbers = F.filter(F.col("turns.turn"), lambda t: t.isNotNull())
    roles = F.transform("turns", lambda t: F.substring(t["role"], 1, 1))
    pairs = F.zip_with(F.slice(roles, 1, F.size(roles) - 1), F.slice(roles, 2, F.size(roles)), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    wrong = lambda pair: ~pair.isin("su", "ua", "au")
    count = lambda fault: F.size(F.filter(F.col("turns.fault"), lambda f: f == fault))
    faults = {f: count(f) for f in ("blank", "duplicate", "truncated")}
    own = repaired.select("conv", "segment", "cost", "audit", F.array_min(numbers).alias("low"), F.array_max(numbers).alias("high"), F.size(F.array_distinct(numbers)).alias("distinct"), roles[0].alias("opens"), F.element_at(roles, -1).alias("closes"), F.size(F.filter(F.slice(pairs, 1, F.size(roles) - 1), wrong)).alias("illegal"), *[n.alias(f) for f, n in faults.items()])
    before = W.partitionBy("conv").orderBy("segment")
    # a turn number or a pair of neighbours may lie across two segments
    across = wrong(F.concat(F.lag("closes").over(before), F.col("opens"))).cast("int")
    met = own.withColumns({"across": F.coalesce(across, F.lit(0)), "shared": F.coalesce((F.lag("high").over(before) == F.col("low")).cast("int"), F.lit(0))})
    total = lambda c: F.sum(c).cast("long")
    told = met.groupBy("conv").agg(F.coalesce(F.max("high") - F.min("low") + 1 - total(F.col("distinct") - F.col("shared")), F.lit(0)).cast("long").alias("gaps"), *[total(f).alias(f) for f in faults], total(F.col("illegal") + F.col("across")).alias("illegal"), total("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("segment", "audit"))).alias("audits"))
    return told.withColumn("audit", F.array_join("audits.audit", "")).drop("audits")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha256): the digest of each repaired conversation's `role:text` lines. Texts pass by segment; no task holds a conversation."""
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    many = repaired.select(F.col("conv").cast("string").alias("conv"), "segment", F.size("repaired").alias("n"), lines.alias("lines"))

    def run(batches):
        import hashlib

        conv, held, began = None, None, False
        for batch in batches:
            done = []
            for key, _, n, text in batch.itertuples(index=False):
                if held is None or key != conv:
                    if held is not None:
                        done.append((conv, held.hexdigest()))
                    conv, held, began = key, hashlib.sha256(), False
                if n:
                    held.update((("\n" if began else "") + text).encode())
                    began = True
            yield pd.DataFrame(done, columns=["conv", "sha256"])
        if held is not None:
            yield pd.DataFrame([(conv, held.hexdigest())], columns=["conv", "sha256"])

    told = many.repartition("conv").sortWithinPartitions("conv", "segment").mapInPandas(run, "conv string, sha256 string")
    return told.withColumn("conv", F.col("conv").cast(repaired.schema["conv"].dataType))
