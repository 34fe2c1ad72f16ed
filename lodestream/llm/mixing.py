"""Mix sources to target weights by hierarchical budgets over seeded epochs.

A token budget goes down a tree of domains, languages and sources. A child that
can't use its share passes the shortage to its siblings, and only what all of
them can't take goes up to the ancestors' siblings. Each leaf then takes the
prefix of its seeded epochs that fills its budget. All amounts are integers, and
everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LEVELS = ("domain", "lang", "source")
#: Leaves whose budgets may be broadcast.
MOST_BROADCAST = 50_000
#: The columns that are added; the input's columns of these names give way.
ADDED = ("mix_domain", "mix_tokens", "mix_epoch")


def token_count(text: Column) -> Column:
    """Words between ASCII white space; null and blank texts have none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column, text_md5: Column) -> Column:
    """A document's place in an epoch, by its id and text: hexadecimal, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text_md5))


def share_out(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Give each parent's ``given`` tokens to its children by weight, within their ``capacity``.

    ``nodes`` has one row per child with its parent's ``given``, its ``weight``,
    ``capacity`` and ``name``. Children are filled in order of capacity per
    weight: those that their share would overfill get their capacity, and the
    rest share what is left. What rounding down leaves goes, a token each, to
    the first of them by name. Children without weight get nothing. Adds
    ``budget``; the children's budgets add up to what is given or, if that is
    less, to their capacities.
    """
    by = Window.partitionBy(*parents)
    rank = by.orderBy(F.col("capacity") / F.greatest(F.col("weight"), F.lit(1)), F.col("name"))
    prior, rest = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    at = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0)))
    at = at.withColumn("taken", F.coalesce(F.sum("capacity").over(prior), F.lit(0))).withColumn("open_w", F.sum("weight").over(rest))
    wide = "decimal(38,0)"
    full = F.col("capacity").cast(wide) * F.col("open_w") <= F.greatest(F.col("given") - F.col("taken"), F.lit(0)).cast(wide) * F.col("weight")
    at = at.withColumn("is_full", full)
    left = F.greatest(F.col("given") - F.sum(F.when(F.col("is_full"), F.col("capacity")).otherwise(F.lit(0))).over(by), F.lit(0))
    rest_w = F.sum(F.when(F.col("is_full"), F.lit(0)).otherwise(F.col("weight"))).over(by)
    at = at.withColumn("left_over", left).withColumn("rest_w", rest_w)
    at = at.withColumn("part", F.when(F.col("is_full"), F.lit(0)).otherwise(F.expr("cast(cast(left_over as decimal(27,0)) * weight div greatest(rest_w, 1) as bigint)")))
    # A child that isn't full has room for more than its share, so for one token more.
    spare = F.when(F.col("rest_w") > 0, F.col("left_over")).otherwise(F.lit(0)) - F.sum("part").over(by)
    turn = F.row_number().over(Window.partitionBy(*parents, "is_full").orderBy("name"))
    at = at.withColumn("spare", spare).withColumn("turn", turn)
    share = F.col("part") + (F.col("turn") <= F.col("spare")).cast("bigint")
    return at.withColumn("budget", F.when(F.col("is_full"), F.col("capacity")).otherwise(share)).drop("taken", "open_w", "is_full", "left_over", "rest_w", "part", "spare", "turn")


def budgets(leaves: DataFrame, total: Column, weights: dict[str, Column], max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) of each leaf of (domain, lang, source, tokens).

    ``weights`` has an integer expression for each level, over that level's
    name columns. A leaf's capacity is its tokens times ``max_epochs``, and a
    node's is that of its children; without weight, it is none. The tables here
    have one row per node of the tree and stay small.
    """
    given = leaves.agg(total.cast("long").alias("given"))
    weighed = lambda at, level: at.withColumn("weight", F.greatest(weights[level].cast("long"), F.lit(0))).withColumn("name", F.col(level))
    room = lambda at: at.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0)))
    nodes = {LEVELS[-1]: room(weighed(leaves.withColumn("capacity", F.col("tokens") * max_epochs), LEVELS[-1]))}
    for i in range(len(LEVELS) - 2, -1, -1):
        below = nodes[LEVELS[i + 1]].groupBy(*LEVELS[: i + 1]).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes[LEVELS[i]] = room(weighed(below, LEVELS[i]))
    found = None
    for i, level in enumerate(LEVELS):
        up = list(LEVELS[:i])
        if found is None:
            at = nodes[level].withColumn("_one", F.lit(1)).join(given.withColumn("_one", F.lit(1)), "_one")
        else:
            at = nodes[level].join(found.select(*up, F.col("budget").alias("given")), up)
        found = share_out(at, up or ["_one"]).select(*LEVELS[: i + 1], "tokens", "budget")
    return found


def mix(docs: DataFrame, domain: Column, weights: dict[str, Column], total: Column | None = None, max_epochs: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Input rows and their epochs, chosen so that leaves' tokens meet their budgets.

    ``total`` is an expression over the leaves' ``tokens`` (default: their sum).
    Returns the input's columns and mix_domain, mix_tokens, mix_epoch (1, 2, ...),
    which take the place of input columns of these names. A leaf takes whole
    epochs and then, in the next epoch's seeded order, the documents up to the
    one whose middle is beyond its budget, so that leaves end as often a little
    above as below. Null languages and sources are leaves named ''. Documents
    without tokens come with every epoch up to the one that is cut, there with
    the prefix. A row's place comes from its id and text (null: empty), so rows
    of one id are spread; of rows that are equal in both, the whole row decides,
    and of wholly equal rows as many are taken as fit. An empty table gives an
    empty result.

    The prefix is found in two steps, so that no task sorts a whole leaf: sums
    over hash buckets of a leaf (as many as the root of its rows), and then the
    different rows of the one bucket in which the budget ends.
    """
    own = "_mix"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    n = lambda name: f"{own}_{name}"
    leaf = [n("domain"), n("lang"), n("source")]
    words = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    at = docs.withColumn(leaf[0], F.coalesce(domain.cast("string"), F.lit("")))
    for name, c in ((leaf[1], lang_col), (leaf[2], source_col)):
        at = at.withColumn(name, F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    at = at.withColumn(n("id"), F.col(f"`{id_col}`")).withColumn(n("text"), F.md5(words.cast("binary"))).withColumn(n("tokens"), token_count(words))
    # Texts are read once; the budgets and buckets come from this table without texts.
    slim = cut(at.select(*leaf, n("id"), n("text"), n("tokens")))
    sums = slim.groupBy(*leaf).agg(F.sum(n("tokens")).alias("tokens"), F.count("*").alias("rows"))
    plan = budgets(sums.select(*(F.col(x).alias(y) for x, y in zip(leaf, LEVELS, strict=True)), "tokens"), F.coalesce(F.sum("tokens"), F.lit(0)) if total is None else total, weights, max_epochs)
    plan = plan.select(*(F.col(y).alias(x) for x, y in zip(leaf, LEVELS, strict=True)), "budget").join(sums, leaf)
    whole = F.expr("case when tokens > 0 then budget div tokens else 0 end").cast("int")
    plan = cut(plan.select(*leaf, whole.alias(n("whole")), (whole + 1).alias(n("last")), (F.col("budget") - whole * F.col("tokens")).alias(n("rest")), F.ceil(F.sqrt("rows")).cast("int").alias(n("parts"))))

    # One row per leaf: broadcast up to a checked number, else joined by shuffle.
    small = plan.count() <= MOST_BROADCAST
    near = F.broadcast if small else (lambda x: x)

    def place(rows: DataFrame) -> DataFrame:
        keyed = rows.join(near(plan), leaf).withColumn(n("key"), order_key(seed, F.col(n("last")), F.col(n("id")), F.col(n("text"))))
        return keyed.withColumn(n("bucket"), F.expr(f"cast(floor(cast(conv(substr({n('key')}, 1, 8), 16, 10) as bigint) * {n('parts')} / 4294967296D) as int)"))

    # The epoch that is cut: the first bucket that doesn't fit as a whole is the one in which the budget ends.
    rest, tokens, bucket, before, end = (F.col(n(x)) for x in ("rest", "tokens", "bucket", "before", "end"))
    filled = place(slim).groupBy(*leaf, n("bucket")).agg(F.sum(tokens).alias(n("n")), F.any_value(rest).alias(n("rest")))
    upto = F.sum(n("n")).over(Window.partitionBy(*leaf).orderBy(n("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = filled.withColumn(n("before"), upto - F.col(n("n")))
    ends = filled.where(before + F.col(n("n")) > rest).groupBy(*leaf).agg(F.min(F.struct(n("bucket"), n("before"))).alias(n("e")))
    ends = cut(ends.select(*leaf, F.col(f"{n('e')}.{n('bucket')}").alias(n("end")), F.col(f"{n('e')}.{n('before')}").alias(n("before"))))
    placed = place(at).join(near(ends), leaf, "left")
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED]
    added = [F.col(leaf[0]).alias("mix_domain"), tokens.alias("mix_tokens")]

    no = F.array().cast("array<int>")
    sure = (rest > 0) & (end.isNull() | (bucket < end))
    epochs = F.concat(F.when(F.col(n("whole")) > 0, F.sequence(F.lit(1), F.col(n("whole")))).otherwise(no), F.when(sure, F.array(n("last"))).otherwise(no))
    plain = placed.select(*columns, *added, F.explode(epochs).alias("mix_epoch"))

    # The bucket that is cut: its different rows in order, each with the number of its copies that are taken.
    row = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), {"ignoreNullFields": "false"}).cast("binary"))
    at_end = placed.where((rest > 0) & (bucket == end)).withColumn(n("row"), row)
    copies = at_end.groupBy(*leaf, n("key"), n("row")).agg(F.count("*").alias(n("copies")), *(F.any_value(n(c)).alias(n(c)) for c in ("tokens", "before", "rest")))
    prior = Window.partitionBy(*leaf).orderBy(n("key"), n("row")).rowsBetween(Window.unboundedPreceding, -1)
    start = before + F.coalesce(F.sum(tokens * F.col(n("copies"))).over(prior), F.lit(0))
    fits = F.when(tokens > 0, F.floor((2 * (rest - F.col(n("start"))) + tokens) / F.greatest(2 * tokens, F.lit(1)))).when(F.col(n("start")) <= rest, F.col(n("copies"))).otherwise(F.lit(0))
    taken = copies.withColumn(n("start"), start).withColumn(n("taken"), F.greatest(F.lit(0), F.least(fits, F.col(n("copies")))).cast("int")).where(F.col(n("taken")) > 0)
    taken = taken.select(*(F.col(c).alias(f"{c}_t") for c in (*leaf, n("key"), n("row"))), n("taken"), n("copies"))
    same = [F.col(c) == F.col(f"{c}_t") for c in (*leaf, n("key"), n("row"))]
    last = at_end.join(taken, same)
    one_each = last.where(F.col(n("taken")) == F.col(n("copies"))).select(*columns, *added, F.col(n("last")).alias("mix_epoch"))
    # Of wholly equal rows some are taken: as many copies of one of them.
    some = last.where(F.col(n("taken")) < F.col(n("copies")))
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    some = some.groupBy(*leaf, n("key"), n("row"), n("taken"), n("last")).agg(*(F.any_value(F.col(f"`{c}`")).alias(c) for c in kept), F.any_value(tokens).alias(n("tokens")))
    some = some.withColumn(n("copy"), F.explode(F.sequence(F.lit(1), F.col(n("taken"))))).select(*columns, *added, F.col(n("last")).alias("mix_epoch"))
    return plain.unionByName(one_each).unionByName(some)
