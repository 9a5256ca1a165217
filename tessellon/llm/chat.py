"""Chat formatting by quotation linking (DataFrame functions only).

Lines that begin with ``>`` are quotes, nested as deep as they have marks. Consecutive quoted lines of one depth
are a passage. Passages and the original messages' own whole texts, paragraphs and lines are normalised (lower case, single
spaces) and hashed; a passage links to the first message of its conversation that holds it and stands before the quoting
one. A passage that is none of these links to the first message that holds it as some of its consecutive lines or
sentences: messages are looked up by the passage's rarest pair of neighbouring lines, and of sentences, and the whole
passage is then compared with their text. A message replies to the latest message that its outermost quotes link to. Following replies up (pointer
jumping, in as many rounds as the logarithm of the deepest thread) gives each message its thread's root and its depth.
reply_order is its place when a thread is read with each message followed by its replies, earlier turns first: the tour
that enters and leaves each message is a list, which is ranked by pointer jumping too. Rows ordered by (conv_id,
thread_root, reply_order) are the reply-ordered conversation, without quotes.

Nothing is gathered per conversation, so one with a third of all messages is spread like the others: originals are
reduced to one row per (conversation, hash) before the join.

Defined results: null text counts as empty; a message without quotes, or none that link, is its own thread at depth
0; rows with a null conv_id or turn link with nothing; messages that share conv_id and turn share their links;
repeated rows stay; an empty table gives an empty table; extra columns are ignored.

The query: the conversations table holds no quotes, so the query first renders it as mail (as_mail): a message is
preceded by the whole message it answers, quoted, with a line that says who wrote it. The operator then has to find the
replies again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellon.llm.common import materialise

QUOTE = r"^(?:[ \t]*>)+[ \t]?"
#: Where one sentence ends and the next begins.
STOP = r"(?<=[.!?…])\s+"
#: Turns of a message's replies that are sorted at once.
SPAN = 4096
#: A line that only says who wrote what is quoted below it.
SAYS = r"(?i)(wrote|schrieb|escribió|écrit)[ \t]*:[ \t]*$"


def _lines(text):
    """depth and body of each line of a text column."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda line: F.struct(F.regexp_count(F.regexp_extract(line, QUOTE, 0), F.lit(">")).alias("depth"), F.regexp_replace(line, QUOTE, "").alias("body")),
    )


def normal(text):
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _name(text):
    return F.sha2(normal(text), 256)


def own_text(text):
    """The text without its quotes and the lines that introduce them."""
    lines = _lines(text)
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.body.alias("body"), x.depth.alias("depth"), F.coalesce(F.get(lines, i + 1).depth, F.lit(0)).alias("next"))), lambda x: (x.depth == 0) & ~((x.next > 0) & x.body.rlike(SAYS)))
    return F.when(F.contains(text, F.lit(">")), F.regexp_replace(F.array_join(F.transform(kept, lambda x: x.body), "\n"), r"^\s+|\s+$", "")).otherwise(F.coalesce(text, F.lit("")))


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, depth, passage: every run of quoted lines of one depth."""
    quoting = messages.where(F.contains("text", F.lit(">"))).select("conv_id", "turn", "text", F.monotonically_increasing_id().alias("m"))
    lines = quoting.select("conv_id", "turn", "m", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).select("conv_id", "turn", "m", "pos", "line.depth", "line.body")
    quoted = lines.where((F.col("depth") > 0) & (F.trim("body") != ""))
    run = F.col("pos") - F.row_number().over(Window.partitionBy("m", "depth").orderBy("pos"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x.body), "\n")
    return quoted.withColumn("run", run).groupBy("conv_id", "turn", "m", "depth", "run").agg(text.alias("passage")).select("conv_id", "turn", "depth", "passage")


def _pieces(text, whole: bool):
    """kind and name of the neighbouring pairs of lines and of sentences in a text column, or its only one; for an index (not whole) all single ones too."""

    def named(kind, units):
        pairs = F.transform(F.filter(F.transform(units, lambda x, i: F.struct(x.alias("a"), F.get(units, i + 1).alias("b"))), lambda x: x.b.isNotNull()), lambda x: F.concat_ws(" ", x.a, x.b))
        used = F.when(F.size(units) > 1, pairs).otherwise(units) if whole else F.concat(units, pairs)
        return F.transform(F.array_distinct(used), lambda x: F.struct(F.lit(kind).alias("kind"), F.sha2(x, 256).alias("piece")))

    lines = F.filter(F.transform(F.split(text, "\n"), normal), lambda x: x != "")
    return F.concat(named("line", lines), named("sentence", F.filter(F.split(normal(text), STOP), lambda x: x != "")))


def _partly(rest: DataFrame, own: DataFrame) -> DataFrame:
    """conv_id, h, part_turn: the first message that holds a passage of rest (conv_id, h, passage) as consecutive lines or sentences of its own."""
    rest = materialise(rest.where("conv_id is not null").groupBy("conv_id", "h").agg(F.min("passage").alias("passage")), "chat-rest")
    wanted = rest.select("conv_id", "h", F.explode(_pieces(F.col("passage"), True)).alias("x")).select("conv_id", "h", "x.*")
    # equal texts count once, at the first of their messages
    texts = own.join(rest.select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id", _name(F.col("own")).alias("name")).agg(F.min(F.struct("turn", "own")).alias("t"))
    texts = materialise(texts.select("conv_id", "name", F.col("t.turn").alias("first_turn"), F.col("t.own").alias("own")), "chat-texts")
    keys = ["conv_id", "kind", "piece"]
    index = texts.select("conv_id", "name", F.explode(_pieces(F.col("own"), False)).alias("x")).select("conv_id", "name", "x.*")
    index = materialise(index.join(wanted.select(*keys).distinct(), keys, "left_semi").distinct(), "chat-index")
    held = wanted.join(index.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left")
    rarest = held.groupBy("conv_id", "h", "kind").agg(F.count("*").alias("all"), F.count("n").alias("some"), F.min(F.when(F.col("n").isNotNull(), F.struct("n", "piece"))).alias("x")).where("all = some").select("conv_id", "h", "kind", "x.piece")
    pairs = rarest.join(index, keys).select("conv_id", "h", "name").distinct()
    found = pairs.join(rest, ["conv_id", "h"]).join(texts, ["conv_id", "name"]).where(F.contains(normal(F.col("own")), normal(F.col("passage"))))
    return materialise(found.groupBy("conv_id", "h").agg(F.min("first_turn").alias("part_turn")), "chat-partly")


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, n_quotes, n_linked, reply_to of the messages that quote."""
    found = materialise(passages(messages).withColumn("h", _name(F.col("passage"))).select("conv_id", "turn", "depth", "h", "passage"), "chat-passages")
    talks = found.select("conv_id").distinct()
    own = messages.join(talks, "conv_id", "left_semi").where("turn is not null").select("conv_id", "turn", own_text(F.col("text")).alias("own"))
    parts = F.concat(F.array("own"), F.split("own", r"\n[ \t]*\n"), F.split("own", "\n"))
    origin = own.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(parts, normal))).alias("p")).where("p <> ''").groupBy("conv_id", F.sha2("p", 256).alias("h")).agg(F.min("turn").alias("first_turn"))
    rows = found.join(origin, ["conv_id", "h"], "left").withColumn("first_turn", F.expr("case when first_turn < turn then first_turn end"))
    rows = materialise(rows, "chat-whole")
    rest = rows.where("first_turn is null")
    if not rest.isEmpty():
        rows = rows.join(_partly(rest, own), ["conv_id", "h"], "left").withColumn("first_turn", F.expr("coalesce(first_turn, case when part_turn < turn then part_turn end)"))
    # the latest of the messages that the least deep quotes come from: one mergeable aggregate, as rows without ids may be many
    outer = F.max(F.struct((-F.col("depth")).alias("up"), "first_turn"))["first_turn"]
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count("first_turn").alias("n_linked"), outer.alias("reply_to"))


def _threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, thread_root, reply_depth of the messages that reply."""
    first = materialise(links.where("reply_to is not null").select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("bigint").alias("depth")), "chat-threads")
    replying = first.select("conv_id", F.col("turn").alias("root"))
    going, done = first.join(replying, ["conv_id", "root"], "left_semi"), first.join(replying, ["conv_id", "root"], "left_anti")
    parts = [materialise(x.select(first.columns), "chat-threads") for x in (going, done)]
    going, done = parts
    while not going.isEmpty():  # those whose root replies to none are set aside
        up = going.withColumn("on", F.lit(True)).unionByName(done.withColumn("on", F.lit(False))).select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), "on")
        step = going.join(up, ["conv_id", "root"]).select("conv_id", "turn", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), "on")
        step = materialise(step, "chat-threads")
        going, done = step.where("on").drop("on"), done.unionByName(step.where("not on").drop("on"))
    return done.select("conv_id", "turn", F.col("root").alias("thread_root"), F.col("depth").alias("reply_depth"))


def _ordered(links: DataFrame) -> DataFrame:
    """conv_id, turn, reply_order of every message that replies or is replied to.

    The tour: entering a message leads to entering its first reply, or else to leaving it; leaving it leads to entering the next reply to the same message, or else to leaving that.
    The next reply is looked up among SPAN turns at once, and beyond them among the first of each span, so a message with any number of replies is sorted in parts.
    """
    kids = links.where("reply_to is not null").select("conv_id", F.col("reply_to").alias("up"), "turn", F.floor(F.col("turn") / SPAN).alias("span"))
    firsts = kids.groupBy("conv_id", "up", "span").agg(F.min("turn").alias("first"))
    firsts = materialise(firsts.withColumn("later", F.lead("first").over(Window.partitionBy("conv_id", "up").orderBy("span"))), "chat-spans")
    here = F.lead("turn").over(Window.partitionBy("conv_id", "up", "span").orderBy("turn"))
    kids = kids.withColumn("here", here).join(firsts.drop("first"), ["conv_id", "up", "span"]).select("conv_id", "up", "turn", F.coalesce("here", "later").alias("next"))
    heads = firsts.groupBy("conv_id", F.col("up").alias("turn")).agg(F.min("first").alias("head"))
    nodes = kids.join(heads, ["conv_id", "turn"], "full")
    event = lambda turn, leaves: F.struct(turn.alias("turn"), F.lit(leaves).alias("leaves"))
    enter = F.struct(F.lit(False).alias("leaves"), F.when(F.col("head").isNotNull(), event(F.col("head"), False)).otherwise(event(F.col("turn"), True)).alias("to"), F.lit(1).cast("bigint").alias("n"))
    leave = F.struct(F.lit(True).alias("leaves"), F.when(F.col("next").isNotNull(), event(F.col("next"), False)).when(F.col("up").isNotNull(), event(F.col("up"), True)).alias("to"), F.lit(0).cast("bigint").alias("n"))
    now = nodes.select("conv_id", "turn", F.explode(F.array(enter, leave)).alias("e")).select("conv_id", "turn", "e.*")
    now = materialise(now, "chat-tour")
    going, done = now.where("to is not null"), now.where("to is null")
    while not going.isEmpty():  # n: messages entered from here up to, but without, to. Events that reach the end are set aside
        ahead = going.unionByName(done).select("conv_id", F.struct("turn", "leaves").alias("to"), F.col("to").alias("then"), F.col("n").alias("more"))
        step = going.join(ahead, ["conv_id", "to"]).select("conv_id", "turn", "leaves", F.col("then").alias("to"), (F.col("n") + F.col("more")).alias("n"))
        step = materialise(step, "chat-tour")
        going, done = step.where("to is not null"), done.unionByName(step.where("to is null"))
    return done.where("not leaves").select("conv_id", "turn", F.col("n").alias("after"))


def threaded(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, n_linked, reply_to, thread_root, reply_depth, reply_order of every message."""
    rows = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", F.col("text").cast("string").alias("text"))
    links = materialise(linked(rows), "chat-links")
    keys = ["conv_id", "turn"]
    after = _ordered(links)
    # a thread's messages that come before one are all but those from it on
    threads = _threads(links)
    own = links.join(threads, keys, "left").join(after, keys, "full").withColumn("thread_root", F.coalesce("thread_root", "turn"))
    whole = after.select("conv_id", F.col("turn").alias("thread_root"), F.col("after").alias("whole"))
    own = materialise(own.join(whole, ["conv_id", "thread_root"], "left").withColumn("reply_order", F.col("whole") - F.col("after")), "chat-own")
    out = rows.join(own, keys, "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("conv_id", "turn", "role", own_text(F.col("text")).alias("text"), none("n_quotes"), none("n_linked"), "reply_to", F.coalesce("thread_root", "turn").alias("thread_root"), none("reply_depth"), none("reply_order"))


def as_mail(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, where text begins with the message answered, quoted whole: that of the turn before, or where conv_id + turn is divisible by 3 the one before that. Of several messages with one conv_id and turn the least text is quoted."""
    rows = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", F.col("text").cast("string").alias("text"))
    said = rows.where("text is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("text", F.coalesce("role", F.lit("?")).alias("who"))).alias("said")).withColumnRenamed("turn", "answers")
    rows = rows.withColumn("answers", F.col("turn") - F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, 2).otherwise(1))
    quote = F.concat(F.col("said.who"), F.lit(" wrote:\n> "), F.replace(F.col("said.text"), F.lit("\n"), F.lit("\n> ")), F.lit("\n\n"))
    return rows.join(said, ["conv_id", "answers"], "left").select("conv_id", "turn", "role", F.concat(F.coalesce(quote, F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return threaded(as_mail(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, min({'t': text, 'w': coalesce(role, '?')}) AS s FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, turn
), m AS (
  SELECT c.conv_id, c.turn, c.role, CASE WHEN s.s IS NULL THEN '' ELSE s.s.w || ' wrote:' || chr(10) || '> ' || replace(s.s.t, chr(10), chr(10) || '> ') || chr(10) || chr(10) END || coalesce(c.text, '') AS text,
         row_number() OVER () AS id
  FROM conversations c LEFT JOIN said s ON s.conv_id = c.conv_id AND s.turn = c.turn - CASE WHEN (c.conv_id + c.turn) % 3 = 0 THEN 2 ELSE 1 END
), l AS (
  SELECT id, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM m
), d AS (
  SELECT id, conv_id, turn, pos, len(regexp_extract_all(regexp_extract(line, '^([ \t]*>)+[ \t]?'), '>')) AS depth,
         regexp_replace(line, '^([ \t]*>)+[ \t]?', '') AS body FROM l
), e AS (
  SELECT *, coalesce(lead(depth) OVER (PARTITION BY id ORDER BY pos), 0) AS next FROM d
), own AS (
  SELECT m.id, m.conv_id, m.turn, m.role,
         CASE WHEN contains(m.text, '>') THEN regexp_replace(coalesce(string_agg(e.body, chr(10) ORDER BY e.pos) FILTER (WHERE e.depth = 0
              AND NOT (e.next > 0 AND regexp_matches(e.body, '(?i)(wrote|schrieb|escribió|écrit)[ \t]*:[ \t]*$'))), ''), '^\s+|\s+$', '', 'g') ELSE m.text END AS text
  FROM m JOIN e USING (id) GROUP BY m.id, m.conv_id, m.turn, m.role, m.text
), q AS (
  SELECT id, conv_id, turn, depth, body, pos, pos - row_number() OVER (PARTITION BY id, depth ORDER BY pos) AS run
  FROM e WHERE depth > 0 AND trim(body) <> ''
), p AS (
  SELECT conv_id, turn, depth, lower(trim(regexp_replace(string_agg(body, chr(10) ORDER BY pos), '\s+', ' ', 'g'))) AS h
  FROM q GROUP BY id, conv_id, turn, depth, run
), o AS (
  SELECT conv_id, h, min(turn) AS first_turn FROM (
    SELECT conv_id, turn, lower(trim(regexp_replace(unnest(list_concat([text], string_split_regex(text, '\n[ \t]*\n'), string_split(text, chr(10)))), '\s+', ' ', 'g'))) AS h FROM own
  ) WHERE h <> '' GROUP BY conv_id, h
), r AS (
  SELECT p.conv_id, p.turn, p.depth, min(p.depth) OVER (PARTITION BY p.conv_id, p.turn) AS top, CASE WHEN o.first_turn < p.turn THEN o.first_turn END AS f
  FROM p LEFT JOIN o ON o.conv_id = p.conv_id AND o.h = p.h
), k AS (
  SELECT conv_id, turn, count(*) AS n_quotes, count(f) AS n_linked, max(f) FILTER (WHERE depth = top) AS reply_to FROM r GROUP BY conv_id, turn
), t AS (
  SELECT conv_id, turn, reply_to AS root, 1 AS depth FROM k WHERE reply_to IS NOT NULL
  UNION ALL
  SELECT t.conv_id, t.turn, k.reply_to, t.depth + 1 FROM t JOIN k ON k.conv_id = t.conv_id AND k.turn = t.root WHERE k.reply_to IS NOT NULL
), z AS (
  SELECT conv_id, turn, arg_max(root, depth) AS thread_root, max(depth) AS reply_depth FROM t GROUP BY conv_id, turn
), v AS (
  SELECT DISTINCT conv_id, thread_root AS root, thread_root AS turn, [thread_root] AS way FROM z
  UNION ALL
  SELECT v.conv_id, v.root, k.turn, list_append(v.way, k.turn) FROM v JOIN k ON k.conv_id = v.conv_id AND k.reply_to = v.turn
), i AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, root ORDER BY way) - 1 AS reply_order FROM v
)
SELECT own.conv_id, own.turn, own.role, own.text, coalesce(k.n_quotes, 0)::BIGINT AS n_quotes, coalesce(k.n_linked, 0)::BIGINT AS n_linked, k.reply_to,
       coalesce(z.thread_root, own.turn) AS thread_root, coalesce(z.reply_depth, 0)::BIGINT AS reply_depth, coalesce(i.reply_order, 0)::BIGINT AS reply_order
FROM own LEFT JOIN k ON k.conv_id = own.conv_id AND k.turn = own.turn LEFT JOIN z ON z.conv_id = own.conv_id AND z.turn = own.turn
     LEFT JOIN i ON i.conv_id = own.conv_id AND i.turn = own.turn"""
