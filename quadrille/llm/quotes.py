"""Chat formatting by quotation linking, with DataFrame functions only.

Lines that begin with ``>`` marks are quotes of that many levels. Runs of lines of one level are
passages; their normalised text (marks off, lower case, white space single) is cut into parts of five words (a shorter
passage is one part, and its last five words are a part in any case), which are hashed and met, inside a
conversation, with the hashes of what messages say themselves: every five words in a row, the whole message, its
paragraphs, its lines. So trimmed and re-wrapped quotes are found as well. A part names the latest earlier turn that
says it; a passage links to the turn that most of its parts name (the later of equal ones), if that is half of them or more. A message replies to the turn that its
outermost linked passage names (the latest of several), else to the turn before it. Messages that answer the turn
before them go on in its branch; any other starts a branch of its own, so that each branch read in order is a
conversation in which every message follows the one it answers, without quotes.

Turns are ordered in slices of a conversation, and slices among each other, so that a conversation which holds a
large part of all rows is no single task's.

Defined cases: a null text is an empty message; a null turn comes before all others and is nobody's original; messages
without a conversation make up one; rows of the same conversation, turn and text are alike and get
the same links, each in its own place; an empty table gives an empty one; columns besides the four are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MARKS, CUT, LEVEL = r"^(\s*>)+ ?", "\x01", "\x02"
#: Words of a part.
PART = 5
#: Turns of a slice.
SLICE = 1024
#: Turns below this stand for a null.
NO_TURN = -(1 << 62)


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _five(words: Column, start: Column) -> Column:
    return F.xxhash64(F.array_join(F.slice(words, start + 1, F.lit(PART)), " "))


def parts(said: Column) -> Column:
    """Hashes of the parts of a passage."""
    words = F.split(said, " ")
    n = F.size(words)
    starts = F.concat(F.sequence(F.lit(0), n - PART, F.lit(PART)), F.when(n % PART != 0, F.array(n - PART)).otherwise(F.array().cast("array<int>")))
    return F.when(n < PART, F.array(F.xxhash64(said))).otherwise(F.transform(starts, lambda i: _five(words, i)))


def parsed(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds body string and passages array<struct<level int, parts array<bigint>>> in order of the text."""
    lines = F.transform(
        F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\x01\x02\r]", ""), "\n"),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("said")),
    )
    with_lines = df.withColumn("lines", lines)
    lines = F.col("lines")
    cut = F.transform(
        lines,
        lambda x, i: F.when((i > 0) & (F.get(lines, i - 1)["level"] == x["level"]), F.concat(F.lit("\n"), x["said"])).otherwise(F.concat(F.lit(CUT), x["level"].cast("string"), F.lit(LEVEL), x["said"])),
    )
    runs = F.transform(
        F.slice(F.split(F.array_join(cut, ""), CUT), 2, 1 << 30),
        lambda r: F.struct(F.substring_index(r, LEVEL, 1).cast("int").alias("level"), normalised(F.substring_index(r, LEVEL, -1)).alias("said")),
    )
    quoted = F.filter(runs, lambda r: (r["level"] > 0) & (r["said"] != ""))
    return with_lines.select(
        *df.columns,
        F.trim(F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["said"]), "\n")).alias("body"),
        F.transform(quoted, lambda r: F.struct(r["level"].alias("level"), parts(r["said"]).alias("parts"))).alias("passages"),
    )


def sayings(body: Column) -> Column:
    """Hashes of what a message says: every five words in a row, all of it, its paragraphs, its lines."""
    texts = F.concat(F.array(body), F.split(body, r"\n\s*\n"), F.split(body, "\n"))
    said = F.filter(F.transform(texts, normalised), lambda t: t != "")
    words = F.split(normalised(body), " ")
    fives = F.when(F.size(words) >= PART, F.transform(F.sequence(F.lit(0), F.size(words) - PART), lambda i: _five(words, i))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(F.transform(said, lambda t: F.xxhash64(t)), fives))


def _links(messages: DataFrame) -> DataFrame:
    """(conv, turn, id, n_quotes, n_linked, replied) of messages with quotes: one sort per part, no pairs.

    Who said a part last is asked in slices of turns, and among slices of the latest in each, so that a line that
    one conversation says very often is no single task's."""
    # no message without the mark quotes, which the scan can tell
    quoting = messages.where(F.contains("text", F.lit(">"))).where(F.size("passages") > 0)
    asked = quoting.select("conv", "turn", "id", F.posexplode("passages").alias("nth", "p"))
    asked = asked.select("conv", "turn", F.posexplode("p.parts").alias("part", "h"), F.lit(0).alias("says"), "id", "nth", F.col("p.level").alias("level")).distinct()
    # only conversations that quote are searched
    with_quotes = quoting.select(F.col("conv").alias("c")).distinct()
    said = messages.where(f"turn > {NO_TURN}").join(with_quotes, F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    says = said.select("conv", "turn", F.explode(sayings(F.col("body"))).alias("h"), F.lit(1).alias("says")).distinct()
    rows = says.unionByName(asked, allowMissingColumns=True).withColumn("slice", F.floor(F.col("turn") / SLICE))
    # a message's own words come after its quotes, so they never answer them
    inside = Window.partitionBy("conv", "h", "slice").orderBy("turn", "says").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spoken = F.when(F.col("says") == 1, F.col("turn"))
    met = rows.withColumn("own", F.last(spoken, ignorenulls=True).over(inside))
    earlier = Window.partitionBy("conv", "h").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy("conv", "h", "slice").agg(F.max(spoken).alias("last"))
    carried = slices.select("conv", "h", "slice", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    same = F.col("m.conv").eqNullSafe(F.col("s.conv")) & (F.col("m.h") == F.col("s.h")) & (F.col("m.slice") == F.col("s.slice"))
    found = met.where("says = 0").alias("m").join(carried.alias("s"), same).select("m.conv", "m.turn", "m.id", "m.nth", "m.level", F.coalesce("m.own", "s.carried").alias("original"))
    # the turn that most parts of a passage name
    by_turn = found.groupBy("conv", "turn", "id", "nth", "level", "original").agg(F.count("*").alias("votes"))
    best = F.max(F.when(F.col("original").isNotNull(), F.struct("votes", "original")))
    passages = by_turn.groupBy("conv", "turn", "id", "nth", "level").agg(best.alias("best"), F.sum("votes").alias("parts"))
    linked = F.when(2 * F.col("best.votes") >= F.col("parts"), F.col("best.original"))
    passages = passages.withColumn("original", linked)
    outer = F.when(F.col("original").isNotNull(), F.struct((-F.col("level")).alias("l"), F.col("original").alias("turn")))
    return passages.groupBy("conv", "turn", "id").agg(F.count("*").alias("n_quotes"), F.count("original").alias("n_linked"), F.max(outer)["turn"].alias("replied"))


def link_quotes(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, parent_turn, branch, place, n_quotes, n_linked, message, chat): a row for each row of df."""
    given = df.select(F.col(conv_col).alias("conv"), F.coalesce(F.col(turn_col).cast("long"), F.lit(NO_TURN)).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    messages = parsed(given).withColumn("id", F.xxhash64("text", "role"))
    links = _links(messages)
    linked = messages.alias("m").join(links.alias("l"), F.col("m.conv").eqNullSafe(F.col("l.conv")) & (F.col("m.turn") == F.col("l.turn")) & (F.col("m.id") == F.col("l.id")), "left")
    rows = linked.select("m.conv", "m.turn", "m.role", "m.id", "body", "replied", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
    rows = rows.withColumn("slice", F.floor(F.col("turn") / SLICE))

    # the turn before, the branch and the place in it: inside a slice first, then what earlier slices hand on
    own = Window.partitionBy("conv", "slice").orderBy("turn", "id")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("before", F.lag("turn").over(own)).withColumn("nth", F.row_number().over(own).cast("long"))
    slices = inside.groupBy("conv", "slice").agg(F.max("turn").alias("last"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("conv", "slice", F.last("last").over(earlier).alias("last_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"))
    joined = inside.alias("r").join(carried.alias("c"), F.col("r.conv").eqNullSafe(F.col("c.conv")) & (F.col("r.slice") == F.col("c.slice")))
    rows = joined.select("r.*", F.coalesce("r.before", "c.last_before").alias("prior"), (F.col("nth") + F.col("n_before")).alias("at"))
    rows = rows.withColumn("parent", F.coalesce("replied", "prior"))
    starts = F.when(F.col("prior").isNull() | (F.col("parent") != F.col("prior")), F.struct("at", "turn"))
    rows = rows.withColumn("start", F.last(starts, ignorenulls=True).over(upto))
    heads = rows.groupBy("conv", "slice").agg(F.max("start").alias("start"))
    heads = heads.select("conv", "slice", F.last("start", ignorenulls=True).over(earlier).alias("start_before"))
    rows = rows.alias("r").join(heads.alias("h"), F.col("r.conv").eqNullSafe(F.col("h.conv")) & (F.col("r.slice") == F.col("h.slice")))
    begin = F.coalesce("r.start", "h.start_before")
    turn = lambda c: F.when(c > NO_TURN, c)
    return rows.select(
        F.col("r.conv").alias(conv_col), turn(F.col("turn")).alias(turn_col), F.col("role").alias(role_col),
        turn(F.col("parent")).alias("parent_turn"), turn(begin["turn"]).alias("branch"), (F.col("at") - begin["at"]).alias("place"),
        "n_quotes", "n_linked", F.col("body").alias("message"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body"), F.lit("\n")).alias("chat"),
    )
