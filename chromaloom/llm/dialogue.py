"""Repair of damaged conversations by a depth-first branch and bound over edit scripts.

A script keeps, reroles or deletes every row and inserts empty messages, so that the roles read
`(s?(ua)+)?`. A node of the search is (rows used, last role written). The stack is explicit and
children are pushed so that scripts are visited in ASCII order of their initials; a prefix goes
on only if its cost plus a lower bound of the rest can still beat the incumbent (cost, audit),
and if no earlier prefix reached the same node as cheaply: an earlier prefix is ASCII-less, so
the later one cannot lead to a better script. The search ends with an empty stack.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaloom.llm.common import ranged_runs
from chromaloom.session import checked_broadcast, cut

SPACES = " \t\n\x0b\x0c\r"
KEEP_CUT, REROLE, DELETE, INSERT = 3, 3, 4, 3     # a truncated row that stays costs KEEP_CUT more
INITIALS = "suax"                                 # x: any other role
CLEAN, CUT, FORCED = range(3)                     # a code is 4 * kind + place in INITIALS
EMPTY, SYSTEM, USER, ASSISTANT = range(4)         # last role written
STEP = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = ("u", "u", "a", "u")                     # the role that may be written next
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
LONG_ROWS, LONG_CHARS = 20_000, 50_000_000        # a larger conversation is solved in segments
SEGMENT = 1_000                                   # rows of a segment
FAN = 64                                          # segments joined in one step


def damage(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(`conv_id:turn`) mod 20.

    0 drops a row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 doubles the row,
    4 makes it the user's. A null is one space in the key, and as a role or text.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = convs.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def own_kind() -> Column:
    """blank (2), truncated (1) or neither (0); duplicates need the rows before."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    return F.when(end == "", FORCED).when(F.substring(end, -1, 1).isin(".", "!", "?"), CLEAN).otherwise(CUT)


def _initial(role: str) -> int:
    return INITIALS.index(role[0]) if role[:1] in ("s", "u", "a") else 3


def rest_bounds(codes: bytes, goal: int) -> list[int]:
    """Lower bound of the cost of rows i and later, for every i.

    Every row has a price of its own; on top, of two rows that would stand side by side
    illegally (or a last row that may not be last) one must be edited or parted, and disjoint
    such pairs add up.
    """
    n = len(codes)
    price, last = (0, KEEP_CUT, DELETE), INITIALS[goal - 1]
    own = [price[c >> 2] if c & 3 < 3 or c >> 2 == FORCED else (REROLE, DELETE)[c >> 2] for c in codes]
    bound, after, between = [0] * (n + 1), n, 0        # after: next row not forced to go; between: price up to it
    for i in reversed(range(n)):
        bound[i] = own[i] + bound[i + 1]
        kind, role = codes[i] >> 2, INITIALS[codes[i] & 3]
        if kind == FORCED:
            between += own[i]
            continue
        if role != "x":
            extra = REROLE if kind == CLEAN else DELETE - KEEP_CUT
            if after == n:
                if role != last:
                    bound[i] = max(bound[i], own[i] + between + extra)
            elif codes[after] & 3 < 3 and role + INITIALS[codes[after] & 3] not in LEGAL:
                extra = min(extra, REROLE if codes[after] >> 2 == CLEAN else DELETE - KEEP_CUT)
                bound[i] = max(bound[i], own[i] + between + own[after] + extra + bound[after + 1])
        after, between = i, 0
    return bound


def first_script(codes: bytes, entry: int, goal: int) -> tuple[int, str]:
    """Some script, the first incumbent: what fits stays, the rest is parted or reroled by a look ahead."""
    at, cost, audit = entry, 0, []
    ahead, following = [3] * len(codes), 3
    for i in reversed(range(len(codes))):
        ahead[i] = following
        following = codes[i] & 3 if codes[i] >> 2 != FORCED else following
    for i, code in enumerate(codes):
        kind, role = code >> 2, INITIALS[code & 3]
        if kind == FORCED or (kind == CUT and role == "x"):
            audit.append("D")
            cost += DELETE
            continue
        cost += KEEP_CUT if kind == CUT else 0
        if (at, role) in STEP:
            at = STEP[at, role]
            audit.append("K")
            continue
        turned = STEP[at, WANTED[at]]                  # after a reroled row, and after an inserted one
        if (turned, role) in STEP and (turned, INITIALS[ahead[i]]) not in STEP:
            at = STEP[turned, role]
            audit.append("IK")
        else:
            at = turned
            audit.append("R")
        cost += REROLE
    while at != goal:
        at = STEP[at, WANTED[at]]
        audit.append("I")
        cost += INSERT
    return cost, "".join(audit)


def solve(codes: bytes, entry: int = EMPTY, goal: int = ASSISTANT) -> tuple[int, str] | None:
    """Cheapest script from one last role to another, ties to the ASCII-least audit; None if
    there is none. Nothing leads back to EMPTY or, past a user, to SYSTEM."""
    n = len(codes)
    if goal in (EMPTY, SYSTEM):
        if entry == goal:
            return DELETE * n, "D" * n
        kept = [(KEEP_CUT * (c >> 2), -i) for i, c in enumerate(codes) if c & 3 == 0 and c >> 2 != FORCED]
        if goal == EMPTY or entry != EMPTY or not kept:
            return None
        cost, i = min(kept)                            # the later the kept row, the more D stand before it
        return DELETE * (n - 1) + cost, "D" * -i + "K" + "D" * (n - 1 + i)
    bound, reached = rest_bounds(codes, goal), {}
    best_cost, best_audit = first_script(codes, entry, goal)
    stack = [(0, entry, 0, "")]
    while stack:
        i, at, cost, audit = stack.pop()
        least = cost + bound[i]
        if least > best_cost or (least == best_cost and audit > best_audit[:len(audit)]) or reached.get((i, at), cost + 1) <= cost:
            continue
        reached[i, at] = cost
        if i == n and at == goal:
            best_cost, best_audit = min((best_cost, best_audit), (cost, audit))
            continue
        # pushed from the ASCII-greatest to the least: R, K, I, D
        turned = STEP[at, WANTED[at]]
        if i < n:
            kind, role = codes[i] >> 2, INITIALS[codes[i] & 3]
            if kind != FORCED:
                stays = KEEP_CUT if kind == CUT else 0
                stack.append((i + 1, turned, cost + REROLE + stays, audit + "R"))
                if (at, role) in STEP:
                    stack.append((i + 1, STEP[at, role], cost + stays, audit + "K"))
        stack.append((i, turned, cost + INSERT, audit + "I"))
        if i < n:
            stack.append((i + 1, at, cost + DELETE, audit + "D"))
    return best_cost, best_audit


def best_script(codes: bytes) -> tuple[int, str]:
    return min(s for s in (solve(codes, EMPTY, EMPTY), solve(codes)) if s is not None)


def written(audit: str, rows: list[tuple[str, str]], at: int = EMPTY):
    """(role, text) of the messages a script leaves, given the last role written before."""
    i = 0
    for edit in audit:
        if edit in "IR":
            role = WANTED[at]
            at = STEP[at, role]
            yield NAMES[role], rows[i][1] if edit == "R" else ""
        elif edit == "K":
            at = STEP[at, rows[i][0][:1]]
            yield rows[i]
        i += edit != "I"


def illegal_pairs(initials: str) -> int:
    return sum(initials[i:i + 2] not in LEGAL for i in range(len(initials) - 1))


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
CHUNKS = "conv_id long, seg long, lines string"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def _result(conv_id, turns, rows) -> tuple:
    """Report and repaired lines (None without any) of one conversation whose rows are in order."""
    seen, codes, faults = set(), bytearray(), [0, 0, 0]
    for role, text, kind in rows:
        repeated = kind != FORCED and (role, text) in seen
        seen.add((role, text))
        fault = 0 if kind == FORCED else 1 if repeated else 2 if kind == CUT else None
        if fault is not None:
            faults[fault] += 1
        codes.append(4 * (FORCED if repeated else kind) + _initial(role))
    cost, audit = best_script(bytes(codes))
    lines = [f"{r}:{t}" for r, t in written(audit, [r[:2] for r in rows])]
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return (conv_id, gaps, *faults, illegal_pairs("".join(INITIALS[c & 3] for c in codes)), cost, audit, 0, "\n".join(lines) if lines else None)


def _short(rows: DataFrame) -> DataFrame:
    """Conversations that fit a task's memory, streamed in order through the tasks: report and
    repaired lines in one row."""
    layout = f"{REPORT}, {CHUNKS.split(', ', 1)[1]}"

    def run(batches):
        schema, held, key, out = _arrow(layout), [], None, []

        def flush():
            if held:
                out.append(_result(key, [r[1] for r in held], [r[2:] for r in held]))
                held.clear()

        def done():
            made = pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
            out.clear()
            return made

        for b in batches:
            for k in range(0, b.num_rows, 512):
                for row in zip(*(c.to_pylist() for c in b.slice(k, 512).columns), strict=True):
                    if held and row[0] != key:
                        flush()
                    key = row[0]
                    held.append(row)
                yield done()
        flush()
        yield done()

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    cols = rows.select("conv_id", "turn", "role", "text", own_kind().alias("kind"))
    return cols.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, layout)


TABLE = "conv_id long, seg long, entry int, goal int, cost long, audit string"


def _joined(parts: pa.Table) -> pa.Table:
    """Cheapest scripts through consecutive segments for every pair of end states."""
    by_seg: dict[int, dict] = {}
    for r in parts.to_pylist():
        by_seg.setdefault(r["seg"], {})[r["entry"], r["goal"]] = (r["cost"], r["audit"])
    first, *others = sorted(by_seg)
    total = by_seg[first]
    for seg in others:
        out: dict = {}
        for (a, b), (c1, a1) in total.items():
            for (b2, c), (c2, a2) in by_seg[seg].items():
                if b == b2 and ((a, c) not in out or (c1 + c2, a1 + a2) < out[a, c]):
                    out[a, c] = (c1 + c2, a1 + a2)
        total = out
    return _table(parts.column("conv_id")[0].as_py(), first // FAN, total)


def _table(conv_id, seg: int, scripts: dict) -> pa.Table:
    return pa.Table.from_pylist([dict(conv_id=conv_id, seg=seg, entry=a, goal=b, cost=c, audit=s) for (a, b), (c, s) in scripts.items()], _arrow(TABLE))


def _dealt(audit: str):
    """A whole audit as one part per segment and the last role written before it.

    Inserts go with the row after them, those at the end with the last row. The roles end with
    an assistant, so an odd number of messages tells that the first one is the system's.
    """
    system = (len(audit) - audit.count("D")) % 2
    start = used = messages = 0
    state = EMPTY
    for k, edit in enumerate(audit):
        if edit != "I" and used == SEGMENT:
            # the inserts right before this row belong to it
            end = k
            while end > start and audit[end - 1] == "I":
                end -= 1
            yield audit[start:end], state
            messages += (end - start) - audit.count("D", start, end)
            state = EMPTY if not messages else SYSTEM if messages == 1 and system else USER if (messages - system) % 2 else ASSISTANT
            start, used = end, 0
        used += edit != "I"
    yield audit[start:], state


def _long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report and chunks of conversations beyond a task's memory, by segments of consecutive rows.

    A segment is searched once for every pair of end states; scripts of neighbouring segments
    join where their states meet, which keeps cost and ASCII order (equal costs never are a
    prefix of each other). Only the audit, which the result holds anyway, and the state of the
    running hash are ever as long as the conversation, or pass it in one stream.
    """
    ranged, runs = ranged_runs(rows.withColumn("kind", own_kind()), "conv_id", ["turn", "role", "text"])
    runs = checked_broadcast(runs.select(F.col("conv_id").alias("cid"), F.col("part").alias("p"), "first", "before"))
    there = (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("cid"))
    placed = cut(ranged.join(runs, there).select("conv_id", "turn", "role", "text", "kind", (F.col("seq") - F.col("first") + F.col("before")).alias("idx")))
    firsts = placed.groupBy("conv_id", F.sha2(F.concat_ws("\0", "role", "text"), 256)).agg(F.min("idx").alias("i")).select(F.col("conv_id").alias("cid"), "i")
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    repeated = F.col("i").isNull() & (F.col("kind") != FORCED)
    marked = cut(placed.join(firsts, F.col("conv_id").eqNullSafe(F.col("cid")) & (F.col("idx") == F.col("i")), "left").select(
        "conv_id", "turn", "role", "text", "idx", F.floor(F.col("idx") / SEGMENT).alias("seg"), repeated.alias("repeated"), "kind",
        (F.when(repeated, FORCED).otherwise(F.col("kind")) * 4 + initial).cast("int").alias("code")))
    known = marked.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        F.count_if(F.col("kind") == FORCED).alias("blank"), F.count_if("repeated").alias("duplicate"),
        F.count_if((F.col("kind") == CUT) & ~F.col("repeated")).alias("truncated"))

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        codes = bytes(group.column("code").to_pylist())
        found = [(a, b, solve(codes, a, b)) for a in range(4) for b in range(4)]
        cid, seg = group.column("conv_id")[0].as_py(), group.column("seg")[0].as_py()
        return pa.Table.from_pylist([{"conv_id": cid, "seg": seg, "n": len(codes), "entry": a, "goal": b, "cost": s[0], "audit": s[1]}
                                     for a, b, s in found if s is not None],
                                    pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("n", pa.int64()), ("entry", pa.int32()),
                                               ("goal", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def neighbours(group: pa.Table) -> pa.Table:
        """Illegal pairs inside a segment, and its two ends."""
        text = "".join(INITIALS[c & 3] for c in group.sort_by("idx").column("code").to_pylist())
        return pa.table({"conv_id": group.column("conv_id").slice(0, 1), "seg": group.column("seg").slice(0, 1),
                         "inside": pa.array([illegal_pairs(text)], pa.int64()), "head": [text[0]], "tail": [text[-1]]})

    def search(group: pa.Table) -> pa.Table:
        codes = bytes(group.sort_by("idx").column("code").to_pylist())
        found = {(a, b): solve(codes, a, b) for a in range(4) for b in range(4)}
        return _table(group.column("conv_id")[0].as_py(), group.column("seg")[0].as_py(), {k: v for k, v in found.items() if v is not None})

    def ends(group: pa.Table) -> pa.Table:
        text = "".join(INITIALS[c & 3] for c in group.sort_by("idx").column("code").to_pylist())
        return pa.table({"conv_id": group.column("conv_id").slice(0, 1), "seg": group.column("seg").slice(0, 1),
                         "inside": pa.array([illegal_pairs(text)], pa.int64()), "head": [text[0]], "tail": [text[-1]]})

    narrow = marked.select("conv_id", "seg", "idx", "code").groupBy("conv_id", "seg")
    seams = cut(narrow.applyInArrow(ends, "conv_id long, seg long, inside long, head string, tail string"))
    past = seams.select(F.col("conv_id").alias("cid"), (F.col("seg") + 1).alias("s"), F.col("tail").alias("past"))
    met = seams.join(past, F.col("conv_id").eqNullSafe(F.col("cid")) & (F.col("seg") == F.col("s")), "left")
    illegal = met.groupBy("conv_id").agg((F.sum("inside") + F.count_if(F.col("past").isNotNull() & ~F.concat("past", "head").isin(*LEGAL))).alias("illegal"))

    scripts = cut(narrow.applyInArrow(search, TABLE))
    while (scripts.agg(F.max("seg")).first()[0] or 0) > 0:
        scripts = cut(scripts.groupBy("conv_id", F.floor(F.col("seg") / FAN).alias("to")).applyInArrow(_joined, TABLE))
    ended = scripts.where((F.col("entry") == EMPTY) & F.col("goal").isin(EMPTY, ASSISTANT))
    whole = cut(ended.groupBy("conv_id").agg(F.min(F.struct("cost", "audit")).alias("s")).select("conv_id", "s.cost", "s.audit"))

    def deal(batches):
        for b in batches:
            for cid, audit in zip(b.column("conv_id").to_pylist(), b.column("audit").to_pylist(), strict=True):
                for seg, (part, at) in enumerate(_dealt(audit)):
                    yield pa.RecordBatch.from_pydict({"conv_id": pa.array([cid], pa.int64()), "seg": [seg], "part": [part], "at": [at]})

    def lines(rows: pa.Table, part: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        messages = list(zip(rows.column("role").to_pylist(), rows.column("text").to_pylist(), strict=True))
        out = [f"{r}:{t}" for r, t in written(part.column("part")[0].as_py(), messages, part.column("at")[0].as_py())]
        return pa.table({"conv_id": rows.column("conv_id").slice(0, 1), "seg": rows.column("seg").slice(0, 1),
                         "lines": pa.array(["\n".join(out) if out else None], pa.string())})

    parts = whole.select("conv_id", "audit").mapInArrow(deal, "conv_id long, seg long, part string, at long")
    text = marked.select("conv_id", "seg", "idx", "role", "text").groupBy("conv_id", "seg")
    chunks = text.cogroup(parts.groupBy("conv_id", "seg")).applyInArrow(lines, CHUNKS)
    report = known
    for side in (illegal, whole):
        side = side.withColumnRenamed("conv_id", "cid")
        report = report.join(side, F.col("conv_id").eqNullSafe(F.col("cid"))).drop("cid")
    return report.select(*[f.split()[0] for f in REPORT.split(", ")]), chunks


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> tuple[DataFrame, DataFrame]:
    """Report per conversation, and the repaired text as numbered chunks of lines.

    `rows` has conv_id, turn, role and text (no null role or text, as `damage` gives them); a
    conversation's rows are taken by turn (null first), equal turns by role, then text, bytewise,
    so copies stand together. Report: gaps in the turns, rows whose first fault is blank,
    duplicate or truncated, illegal neighbours, and cost and audit of the cheapest script.
    Chunks: conv_id, seg, lines (`role:text` by newlines; null if nothing is left). A null
    conv_id is a conversation of its own. No row, no conversation. Other columns are not read.
    Conversations above `long_rows` rows or `long_chars` characters go by segments; the result
    is the same.
    """
    rows = rows.select("conv_id", "turn", "role", "text")
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("k"), F.sum(F.length("text")).alias("c"))
    large = cut(sizes.where((F.col("k") > long_rows) | (F.col("c") > long_chars)).select(F.col("conv_id").alias("cid")))
    names = [f.split()[0] for f in REPORT.split(", ")]
    if large.isEmpty():
        done = cut(_short(rows))
        return done.select(*names), done.select("conv_id", "seg", "lines")
    same = F.col("conv_id").eqNullSafe(F.col("cid"))
    done = cut(_short(rows.join(large, same, "left_anti")))
    report, chunks = _long(rows.join(large, same, "left_semi"))
    return done.select(*names).unionByName(report), done.select("conv_id", "seg", "lines").unionByName(chunks)


def digests(chunks: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of its chunks' lines in order, joined by newlines.

    The chunks of a conversation pass a running hash one after the other.
    """
    def run(batches):
        key, open_, first, hashed = None, False, True, sha256()
        for b in batches:
            ids, out = [], []
            for cid, lines in zip(b.column("conv_id").to_pylist(), b.column("lines").to_pylist(), strict=True):
                if open_ and cid != key:
                    ids.append(key)
                    out.append(hashed.hexdigest())
                    hashed, first = sha256(), True
                key, open_ = cid, True
                if lines is not None:
                    hashed.update(lines.encode() if first else b"\n" + lines.encode())
                    first = False
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, pa.int64()), "sha": pa.array(out, pa.string())})
        if open_:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([key], pa.int64()), "sha": [hashed.hexdigest()]})

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "seg")]
    ordered = chunks.select("conv_id", "seg", "lines").repartition("conv_id").sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "conv_id long, sha string")


def repair_damaged(convs: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> DataFrame:
    """Every conv_id of `convs` with the report of its repair after damage and the digest of the
    repaired text. A conversation that loses every row has zeros, an empty audit and the digest
    of the empty text; an empty table gives no row."""
    report, chunks = repair(damage(convs), long_rows, long_chars)
    out = convs.select("conv_id").distinct()
    for side in (report, digests(chunks)):
        side = side.withColumnRenamed("conv_id", "cid")
        out = out.join(side, F.col("conv_id").eqNullSafe(F.col("cid")), "left").drop("cid")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"))
