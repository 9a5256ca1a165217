"""Conversation structure repair by dynamic programming over a time-major tensor.

A conversation's rows become a role initial and two flags each. Conversations are bucketed by length, and a bucket is one
tensor: for each turn, from the last to the first, the least cost of what is left is computed for all its conversations
and all four states of the wanted pattern at once, and stored. The edits are then traced from the first turn on, again
for all conversations of the bucket at once: of the edits that keep to the stored cost the one whose initial is least in
ASCII, which gives the least audit as a whole, since an edit's initial decides the state that follows.

The pattern is ``(s?(ua)+)?`` over initials of system, user and assistant. States: nothing yet, after system, after
user, after assistant. Keep costs 0, rerole to user or assistant 3, delete 4, insert an empty user or assistant row 3; blank
and duplicate rows must be deleted, a truncated row that stays costs 3 more.

Rows reach a task sorted by conversation and stream through it: the first pass carries 9 bytes a row and no texts, the
second applies a conversation's audit to its rows as they come. So a conversation of any length takes memory for its codes
and stored costs (26 bytes a row), not for its texts; its audit and digest are sequential, so they are made by one task.

Defined results: a null conv_id is a conversation of its own; a null role or text counts as one space, and so does a null
conv_id or turn in the damage key; rows of equal turn (null turns first) go by role, then by the digest of role and text;
an empty role has no initial and can't be kept; repeated rows are duplicates; a conversation all of whose rows
are lost still returns its row; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the edits cost, and what a truncated row that stays costs more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The ASCII white space that texts are trimmed of.
SPACES = " \t\n\x0b\x0c\r"
#: State after an insertion or rerole, by state; what the end of the rows costs, by state.
STEP, END = (2, 2, 3, 2), (0, 2 * INSERT, INSERT, 0)
#: State after a kept row, by state and initial (s, u, a, any other); -1 where it can't be kept.
KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
NEVER = 1 << 29
#: Rows of repaired conversations that a task gathers before it hands them on, and their characters.
OUT_ROWS, OUT_CHARS = 10_000, 16 << 20
EDITS = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _rows(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by rule: of 20 hash values of conversation and turn, 0 loses the row, 1 its text, 2 its sentence ends, 3 repeats it, 4 makes it the user's."""
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))) % 20
    rows = _rows(conversations).withColumn("_kind", kind).where("_kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _digest() -> Column:
    """Of role and text, by which rows are told to be the same."""
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _costs(kind, must, extra, length):
    """Stored costs [turn, state, conversation]: the least cost of the rows from a turn on, from each state."""
    import numpy as np

    most, n = kind.shape
    cost = np.empty((most + 1, 4, n), np.int32)
    cost[most] = np.array(END, np.int32)[:, None]
    kept = np.array(KEPT)
    for t in range(most - 1, -1, -1):
        after = cost[t + 1]
        own = np.minimum(DELETE + after, _changed(after, must[t], REROLE + extra[t]))
        for s in range(4):
            to = kept[s][kind[t]]
            own[s] = np.minimum(own[s], np.where((to >= 0) & ~must[t], KEEP + extra[t] + after[to, np.arange(n)], NEVER))
        two, three = np.minimum(own[2], INSERT + own[3]), np.minimum(own[3], INSERT + own[2])
        cost[t] = np.minimum(own[0], INSERT + two), np.minimum(own[1], INSERT + two), two, three
        over = t >= length
        cost[t][:, over] = cost[most][:, over]
    return cost


def _changed(after, must, price):
    """Cost of a rerole from each state."""
    import numpy as np

    return np.where(must, NEVER, price + after[np.array(STEP)])


def _trace(kind, must, extra, length, cost):
    """Initials of the edits [plane, conversation], 0 for none; three planes a turn (two insertions, then the row's edit) and two for the end."""
    import numpy as np

    most, n = kind.shape
    at, step, kept = np.arange(n), np.array(STEP), np.array(KEPT)
    state, planes = np.zeros(n, np.int64), np.zeros((3 * most + 2, n), np.uint8)
    for t in range(most):
        here, after, live = cost[t], cost[t + 1], t < length
        for round_ in (0, 1, 2):
            left = here[state, at]
            delete = live & (DELETE + after[state, at] == left)
            insert = live & ~delete & (INSERT + here[step[state], at] == left)
            if round_ == 2:
                break
            planes[3 * t + round_, insert] = ord("I")
            state = np.where(insert, step[state], state)
        to = kept[state, kind[t]]
        keep = live & ~delete & ~must[t] & (to >= 0) & (KEEP + extra[t] + after[to, at] == left)
        planes[3 * t + 2] = np.where(delete, ord("D"), np.where(keep, ord("K"), np.where(live, ord("R"), 0)))
        state = np.where(delete | ~live, state, np.where(keep, to, step[state]))
    for round_ in (0, 1):
        insert = (state == 1) | (state == 2)
        planes[3 * most + round_, insert] = ord("I")
        state = np.where(insert, step[state], state)
    return planes


def solve(kind, must, short, length):
    """Cost and audit of each conversation. kind (0 to 3: s, u, a, other), must (be deleted) and short (truncated) are flat, conversation after conversation."""
    import numpy as np

    n, begin = len(length), np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
    cost, audit = np.zeros(n, np.int64), np.full(n, "", object)
    bucket = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
    for b in np.unique(bucket[length > 0]):
        own = np.flatnonzero((bucket == b) & (length > 0))
        size = length[own]
        turn = np.arange(size.max())[:, None]
        inside = turn < size
        place = np.where(inside, begin[own] + turn, 0)
        grid = [np.where(inside, x[place], 0) for x in (kind, must, short)]
        args = grid[0].astype(np.int64), grid[1].astype(bool), TRUNCATED * grid[2].astype(np.int32), size
        stored = _costs(*args)
        cost[own] = stored[0, 0]
        letters = np.ascontiguousarray(_trace(*args, stored).T)
        ends = np.concatenate([[0], np.cumsum((letters > 0).sum(1))])
        text = letters[letters > 0].tobytes().decode("ascii")
        audit[own] = [text[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return cost, audit


def _told(conv, kind, valid, turn, code):
    """An Arrow batch of EDITS for whole conversations, each begun by a marker row (kind 0)."""
    import numpy as np
    import pyarrow as pa

    start = np.flatnonzero(kind == 0)
    length = np.diff(np.append(start, len(kind))) - 1
    n, row = len(start), kind == 1
    of = np.repeat(np.arange(n), length)
    turn, valid, code = turn[row], valid[row], code[row]
    role, blank, twice, short = code & 3, code & 4 > 0, code & 8 > 0, code & 16 > 0
    twice &= ~blank
    short &= ~blank & ~twice
    count = lambda mask: np.bincount(of[mask], minlength=n).astype(np.int64)
    same = of[1:] == of[:-1]
    pair = role[:-1] * 4 + role[1:]
    illegal = np.append(same & ~np.isin(pair, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1)), False) if len(of) else np.zeros(0, bool)
    when, whose = turn[valid], of[valid]
    fresh = np.append(True, (whose[1:] != whose[:-1]) | (when[1:] != when[:-1])) if len(whose) else np.zeros(0, bool)
    gaps = np.zeros(n, np.int64)
    has, lo = np.unique(whose, return_index=True)
    hi = np.append(lo[1:], len(whose)) - 1
    if len(has):
        gaps[has] = when[hi] - when[lo] + 1 - np.bincount(whose[fresh], minlength=n)[has]
    cost, audit = solve(role, blank | twice, short, length)
    return pa.RecordBatch.from_arrays([conv.take(pa.array(start)), *(pa.array(x) for x in (gaps, count(blank), count(twice), count(short), count(illegal), cost)), pa.array(audit.tolist(), pa.string())], names=[c.split()[0] for c in EDITS.split(", ")])


def edits(rows: DataFrame) -> DataFrame:
    """The faults of each conversation of rows (conv_id, turn, role, text), and its cheapest repair: cost and audit.

    Rows without a turn, role and text only say that the conversation is there; see query().
    """

    def run(batches):
        import numpy as np

        held = []
        for b in batches:
            if not b.num_rows:
                continue
            starts = np.flatnonzero(np.asarray(b.column(1)) == 0)
            if held and len(starts):
                held.append(b.slice(0, starts[-1]))
                yield from _solved(held)
                held = [b.slice(starts[-1])]
            elif len(starts):
                yield from _solved([b.slice(0, starts[-1])])
                held = [b.slice(starts[-1])]
            else:
                held.append(b)
        if held:
            yield from _solved(held)

    def _solved(parts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        t = pa.Table.from_batches(parts).combine_chunks()
        if t.num_rows:
            turn = t["turn"].combine_chunks()
            yield _told(t["conv_id"].combine_chunks(), np.asarray(t["kind"]), np.asarray(pc.is_valid(turn)), np.asarray(pc.fill_null(turn, 0)), np.asarray(t["code"]))

    end = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + F.when(end == "", 4).otherwise(0) + F.when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(16)
    # the window takes the partitioning that is there already; each occurrence but the first is a duplicate
    own = rows.select("conv_id", "turn", "role", code.alias("code"), _digest().alias("digest")).withColumn("kind", F.when(F.col("role").isNull(), 0).otherwise(1)).repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy("turn"))
    own = own.withColumn("nth", F.when(F.col("kind") == 1, nth).otherwise(F.lit(0)))
    own = own.sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest", "nth")
    return own.select("conv_id", F.col("kind").cast("int").alias("kind"), "turn", (F.coalesce("code", F.lit(0)) + F.when(F.col("nth") > 1, 8).otherwise(0)).cast("int").alias("code")).mapInArrow(run, EDITS)


def with_markers(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """rows, and for each conversation a row that has only its id."""
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    return rows.unionByName(ids.select("conv_id", null("bigint", "turn"), null("string", "role"), null("string", "text")))


def _applied(rows: DataFrame, told: DataFrame, sink, schema: str) -> DataFrame:
    """What sink makes of each conversation's edits (columns of told) and repaired rows, streamed in order."""
    names = told.columns
    first = told.withColumns({"kind": F.lit(0), "turn": F.lit(None).cast("bigint"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "digest": F.lit(None).cast("binary")})
    later = rows.select("conv_id", "turn", "role", "text", _digest().alias("digest"), F.lit(1).alias("kind"))
    both = first.unionByName(later, allowMissingColumns=True).repartition("conv_id")
    both = both.sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest").select(*names, "kind", "role", "text")

    def run(batches):
        out, now = sink(), None
        for b in batches:
            kinds, roles, texts = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("kind", "role", "text"))
            for i, kind in enumerate(kinds):
                if kind == 0:
                    if now is not None:
                        yield from now.end()
                    now = _Conversation({c: b.column(k)[i].as_py() for k, c in enumerate(names)}, out)
                else:
                    yield from now.row(roles[i], texts[i])
        if now is not None:
            yield from now.end()
        yield from out.rest()

    return both.mapInArrow(run, schema)


class _Conversation:
    """A conversation that is being repaired: its audit, how far it is applied, and the state."""

    def __init__(self, told: dict, out):
        self.told, self.audit, self.at, self.state, self.out = told, told["audit"], 0, 0, out
        out.begin(told)

    def _made(self, text: str, edit: str):
        role = "assistant" if self.state == 2 else "user"
        self.state = STEP[self.state]
        return self.out.put(role, text, edit)

    def _inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield from self._made("", "I")

    def row(self, role: str, text: str):
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield from self._made(text, "R")
        elif edit == "K":
            self.state = KEPT[self.state]["sua".index(role[0])]
            yield from self.out.put(role, text, "K")

    def end(self):
        yield from self._inserted()
        yield from self.out.end()


class _Rows:
    """Hands repaired rows on in batches."""

    def __init__(self):
        self.held, self.chars = [], 0

    def begin(self, told):
        self.conv, self.n = told["conv_id"], 0

    def put(self, role, text, edit):
        self.held.append((self.conv, self.n, role, text, edit))
        self.n, self.chars = self.n + 1, self.chars + len(text)
        if len(self.held) >= OUT_ROWS or self.chars >= OUT_CHARS:
            yield from self.rest()

    def end(self):
        return ()

    def rest(self):
        import pyarrow as pa

        columns = zip(*self.held) if self.held else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["conv_id", "position", "role", "text", "edit"])
        self.held, self.chars = [], 0


class _Digests:
    """Hands on what is told of each conversation with the digest of its repaired rows."""

    def __init__(self):
        self.held = []

    def begin(self, told):
        self.told, self.sha, self.any = told, hashlib.sha256(), False

    def put(self, role, text, edit):
        self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True
        return ()

    def end(self):
        self.held.append(self.told | {"repaired_sha256": self.sha.hexdigest()})
        if len(self.held) >= OUT_ROWS:
            yield from self.rest()

    def rest(self):
        import pyarrow as pa

        kinds = {"audit": pa.string(), "repaired_sha256": pa.string()}
        names = [*(c.split()[0] for c in EDITS.split(", ")), "repaired_sha256"]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in self.held], kinds.get(c, pa.int64())) for c in names], names=names)
        self.held = []


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, position, role, text, edit (K, R or I) of the rows of each repaired conversation."""
    rows = _rows(conversations)
    return _applied(rows, edits(with_markers(rows, conversations)), _Rows, "conv_id bigint, position bigint, role string, text string, edit string")


def query(spark, sf_dir: str) -> DataFrame:
    whole = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = damaged(whole)
    return _applied(rows, edits(with_markers(rows, whole)), _Digests, f"{EDITS}, repaired_sha256 string")
