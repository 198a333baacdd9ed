"""Names that mean the same: what a greedy pass over them in order would merge, computed in parallel.

The pass takes each name in turn; it joins an earlier one that it resembles, or
stands for itself. Only names that resemble each other matter to each other, so the
pass is a question about a graph: its edges come from a blocked join, and rounds of
joins settle all names whose earlier neighbours are settled. Where a name joins the
first leader that it resembles, only leaders matter to later names: names are taken
in a few batches in order, and all but those that resemble no earlier leader are
never compared with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import levenshtein_similarity
from lodestone.operators.ordering import numbered
from lodestone.sources.scratch import drop_stored, scratch_path, stored

#: Edits up to which names are found by deletions, and characters up to which three are few: a name of l characters makes l * (l - 1) * (l - 2) / 6 rows at most, or l * (l - 1) / 2.
FEW_EDITS, FEW_CHARACTERS = 3, 19
#: Places of the first batch of a greedy pass at least, and how many times as far each next batch goes.
FIRST, TIMES = 200_000, 6


def _edits(length: Column, share: float) -> Column:
    """Edits at which a name of so many characters is still like another one by ``share``; rounding errors allow one rather than none."""
    return F.floor(length * (1 - share) + 1e-9).cast("int")


def _few(length: Column, share: float) -> Column:
    """Whether names like one of so many characters are found by deletions."""
    edits = _edits(length, share)
    return (edits < FEW_EDITS) | ((edits == FEW_EDITS) & (length <= FEW_CHARACTERS))


def _parts(names: DataFrame, share: float, others: DataFrame | None = None) -> DataFrame:
    """Pairs of rows of ``names`` (``k``, ``t``, ``n``) and of ``others``, or of the same ones, no longer (columns end in 2), that share a part: all that may be alike where many edits are allowed.

    Where the longer of two names has ``l`` characters, no more than e = floor((1 - share) * l)
    edits lie between them. Cut into e + 1 parts from 0, the first part i up to which no more
    than i edits lie is whole, with i edits before it and no more than e - i behind: so far at
    most the shorter name has that part from where the longer one has it, seen from either end.
    So each name offers its own parts, and asks for parts of every length it may meet.
    """
    edits = _edits(F.col("l"), share)
    width = F.floor(F.col("l") / (F.col("e") + 1)).cast("int")
    # a part's start and length: the last parts of a name that doesn't divide are longer by one
    short = F.col("e") + 1 - F.col("l") % (F.col("e") + 1)
    start = F.col("i") * F.col("w") + F.greatest(F.col("i") - short, F.lit(0)) + 1
    size = F.col("w") + (F.col("i") >= short).cast("int")
    many = ~_few(F.col("l"), share)
    offered = names.withColumn("l", F.col("n")).withColumn("e", edits).filter(many).withColumn("w", width).withColumn("i", F.explode(F.expr("sequence(0, e)"))).withColumn("s", start.cast("int")).withColumn("z", size.cast("int"))
    offered = offered.select("k", "t", "l", "i", F.expr("substring(t, s, z)").alias("part"))
    asked = (names if others is None else others).withColumn("l", F.explode(_lengths(share))).withColumn("e", edits).filter(many & (F.col("l") - F.col("n") <= F.col("e"))).withColumn("w", width).withColumn("i", F.explode(F.expr("sequence(0, e)"))).withColumn("s", start.cast("int")).withColumn("z", size.cast("int"))
    # what is left of the name must hold the part
    asked = asked.withColumn("low", F.expr("greatest(s - i, s + n - l - (e - i), 1)")).withColumn("high", F.expr("least(s + i, s + n - l + (e - i), n - z + 1)")).filter("low <= high")
    asked = asked.withColumn("p", F.explode(F.expr("sequence(low, high)"))).select(F.col("k").alias("k2"), F.col("t").alias("t2"), "l", "i", F.expr("substring(t, p, z)").alias("part")).distinct()
    return offered.join(asked, ["l", "i", "part"]).select("k", "t", "k2", "t2")


def _lengths(share: float) -> Column:
    """Lengths of the longer names that one of ``n`` characters may be like."""
    return F.sequence(F.col("n"), F.floor(F.col("n") / share + 1e-9).cast("int"))


def _less(names: DataFrame) -> DataFrame:
    """Rows of ``names`` (``k``, ``t``, ``l``, ``d``) with a hash of ``l`` and what is left of ``t`` without ``d`` of its characters, 0 to 3, for each choice of them.

    Of equal characters in a row the first ones go, so that few rows tell the same.
    """
    first = lambda at: F.expr(f"substring(t, {at}, 1) <> substring(t, {at} - 1, 1)")
    key = lambda left: ["k", "t", "l", F.xxhash64("l", left).alias("left")]
    none = names.filter("d = 0").select(*key(F.col("t")))
    one = names.filter("d >= 1").withColumn("i", F.explode(F.expr("sequence(1, length(t))"))).filter((F.col("i") == 1) | first("i"))
    two = one.filter("d >= 2 and i < length(t)").withColumn("j", F.explode(F.expr("sequence(i + 1, length(t))"))).filter((F.col("j") == F.col("i") + 1) | first("j"))
    three = two.filter("d = 3 and j < length(t)").withColumn("m", F.explode(F.expr("sequence(j + 1, length(t))"))).filter((F.col("m") == F.col("j") + 1) | first("m"))
    out = none.unionByName(one.filter("d = 1").select(*key(F.expr("concat(substring(t, 1, i - 1), substring(t, i + 1))"))))
    out = out.unionByName(two.filter("d = 2").select(*key(F.expr("concat(substring(t, 1, i - 1), substring(t, i + 1, j - i - 1), substring(t, j + 1))"))))
    return out.unionByName(three.select(*key(F.expr("concat(substring(t, 1, i - 1), substring(t, i + 1, j - i - 1), substring(t, j + 1, m - j - 1), substring(t, m + 1))"))))


def _deletions(names: DataFrame, share: float, others: DataFrame | None = None) -> DataFrame:
    """Pairs of rows of ``names`` (``k``, ``t``, ``n``), or of one of those and one of ``others`` (columns end in 2), that few edits make alike; pairs may come several times.

    With e edits at most between names of ``l`` and ``n`` <= ``l`` characters, some e
    deletions in the longer and e - (l - n) in the shorter one leave the same. Without
    ``others`` both sides of the join are the same rows, which are exchanged once.
    """

    def left(own: DataFrame) -> DataFrame:
        own = own.withColumn("l", F.explode(_lengths(share))).withColumn("d", _edits(F.col("l"), share) - (F.col("l") - F.col("n")))
        return _less(own.filter(_few(F.col("l"), share) & (F.col("d") >= 0)).select("k", "t", "l", "d"))

    one = left(names)
    # one whole number as the key: rows are sorted by it without a look at them
    met = one.alias("a").join((one if others is None else left(others)).alias("b"), F.col("a.left") == F.col("b.left"))
    met = met.select("a.k", "a.t", F.col("b.k").alias("k2"), F.col("b.t").alias("t2"), F.greatest("a.l", "b.l").alias("l"))
    met = met.filter((F.greatest(F.length("t"), F.length("t2")) == F.col("l")) & (F.lit(True) if others is not None else F.col("k") < F.col("k2")))
    return met.withColumn("far", F.levenshtein("t", "t2", FEW_EDITS)).filter((F.col("far") >= 0) & (F.col("far") <= _edits(F.col("l"), share))).select("k", "t", "k2", "t2")


def _near(share: float) -> Column:
    """Whether ``t`` and ``t2`` are alike by ``share``."""
    return F.levenshtein("t", "t2", int(1e9)) <= F.greatest(F.length("t"), F.length("t2")) * (1 - share) + 1e-9


def _across(names: DataFrame, others: DataFrame, share: float) -> DataFrame:
    """``a`` and ``b`` of rows of ``names`` and of ``others`` (``k``, ``t``, ``n``) that are alike by ``share``; pairs may come several times."""
    met = _deletions(names, share, others).select("k", "k2")
    longer = _parts(names, share, others).filter(_near(share)).select("k", "k2")
    shorter = _parts(others, share, names).filter(F.length("t2") < F.length("t")).filter(_near(share)).select(F.col("k2").alias("k"), F.col("k").alias("k2"))
    return met.unionByName(longer).unionByName(shorter).select(F.col("k").alias("a"), F.col("k2").alias("b"))


def alike(names: DataFrame, share: float = 0.8, name: str = "name", key: str = "place") -> DataFrame:
    """Pairs of different rows whose names have an edit similarity of ``share`` or more; case doesn't count.

    Exact, without comparing all pairs. Where up to ``FEW_EDITS`` edits are allowed, names
    are compared that come to the same by as many deletions: short parts of names are too
    common to choose by. Longer names are compared where they share a part. ``a`` is the
    smaller key.
    """
    own = names.select(F.col(key).alias("k"), F.lower(name).alias("t")).withColumn("n", F.length("t")).filter("n > 0")
    # what met is compared where it meets: only pairs that are alike are exchanged
    near = _deletions(own, share).unionByName(_parts(own, share).filter("k <> k2").filter(_near(share)))
    return near.select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b"), levenshtein_similarity(F.col("t"), F.col("t2")).alias("similarity")).distinct()


def first_leaders(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``place`` and ``leader`` of each node of a greedy pass that lets every node join its first leader before it, or lead.

    ``pairs`` has ``a`` < ``b``. A node all of whose earlier neighbours follow is a
    leader, a node with a leader before it follows; each round settles every node that
    those settled so far decide, and at least the first that is undecided. Rounds add
    to one folder, so that no plan grows with their number.
    """
    spark = pairs.sparkSession
    every = stored(pairs.select("a", "b"), "greedy-pairs")
    open_pairs, fell, turn = every, scratch_path(spark, "greedy-followers"), 0
    while not open_pairs.isEmpty():
        # undecided nodes with no undecided node before them lead
        ahead = stored(open_pairs.select(F.col("a").alias("place")).distinct().join(open_pairs.select(F.col("b").alias("place")), "place", "left_anti"), "greedy-leaders")
        open_pairs.join(ahead.select(F.col("place").alias("a")), "a", "left_semi").select(F.col("b").alias("place")).distinct().write.parquet(f"{fell}/round={turn}")
        fallen = spark.read.schema(ahead.schema).parquet(f"{fell}/round={turn}")
        decided = fallen.unionByName(ahead)
        left = stored(open_pairs.join(decided.select(F.col("place").alias("a")), "a", "left_anti").join(decided.select(F.col("place").alias("b")), "b", "left_anti").select("a", "b"), "greedy-pairs")
        drop_stored(ahead, *([open_pairs] if open_pairs is not every else []))
        open_pairs, turn = left, turn + 1
    if not turn:
        return nodes.select("place", F.col("place").alias("leader"))
    followers = spark.read.schema(nodes.select("place").schema).option("recursiveFileLookup", "true").parquet(fell)
    # whoever never fell leads; a follower joins the first of the leaders before it
    joined = every.join(followers.select(F.col("place").alias("a")), "a", "left_anti").join(followers.select(F.col("place").alias("b")), "b", "left_semi").groupBy(F.col("b").alias("place")).agg(F.min("a").alias("leader"))
    return nodes.select("place").join(joined, "place", "left").select("place", F.coalesce("leader", "place").alias("leader"))


def leaders(names: DataFrame, share: float = 0.8, name: str = "name") -> DataFrame:
    """``place`` and ``leader`` of each name of a greedy pass by ``place`` that lets it join the first leader before it that it resembles by ``share``, or lead.

    A batch of names is held against the leaders of the batches before. Those that resemble
    one join the first of them, which comes before any leader of their own batch; only the
    others are compared with each other. Names that lead are few where many resemble each
    other, so pairs grow with the names and not with what resembles each other.
    """
    own = names.select("place", name)
    parts = lambda df: df.select(F.col("place").alias("k"), F.lower(name).alias("t")).withColumn("n", F.length("t")).filter("n > 0")
    last = own.agg(F.max("place")).first()[0] or 0
    ends = [last]
    while ends[-1] > FIRST:
        ends.append(ends[-1] // TIMES)
    led, ahead, start = [], None, 0
    for end in reversed(ends):
        batch = own.filter((F.col("place") > start) & (F.col("place") <= end))
        if ahead is not None:
            found = stored(_across(parts(ahead), parts(batch), share).groupBy(F.col("b").alias("place")).agg(F.min("a").alias("leader")), "greedy-found")
            led.append(found)
            batch = stored(batch.join(found.select("place"), "place", "left_anti"), "greedy-rest")
        among = stored(first_leaders(batch, stored(alike(batch, share, name), "greedy-edges")), "greedy-led")
        led.append(among)
        fresh = batch.join(among.filter("place = leader").select("place"), "place", "left_semi")
        ahead, start = fresh if ahead is None else ahead.unionByName(fresh), end
        if end != last:
            ahead = stored(ahead, "greedy-leaders")
    every = led[0]
    for more in led[1:]:
        every = every.unionByName(more)
    return every


def best_leaders(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``place`` and ``leader`` of a greedy pass that lets every node join the group of the node before it that it resembles most.

    ``pairs`` has ``a`` < ``b`` and ``similarity``; of equally similar nodes the one of
    the earliest group counts. A group is known by its first node. A round reads what
    the round before has settled and what still waits; all rounds add to one folder, so
    that no plan grows with their number.
    """
    spark = pairs.sparkSession
    settled, turn = scratch_path(spark, "greedy-settled"), 0
    most = pairs.groupBy("b").agg(F.max("similarity").alias("similarity"))
    best = stored(pairs.join(most, ["b", "similarity"]).select("a", "b"), "greedy-best")
    # all its best nodes decided, a node is too: a round settles at least the earliest of the undecided
    front = nodes.select("place").join(best.select(F.col("b").alias("place")), "place", "left_anti").select("place", F.col("place").alias("leader"))
    waiting = best.withColumn("leader", F.lit(None).cast(front.schema["leader"].dataType))
    front.write.parquet(f"{settled}/round={turn}")
    while not waiting.isEmpty():
        front = spark.read.schema(front.schema).parquet(f"{settled}/round={turn}")
        told = waiting.join(front.select(F.col("place").alias("a"), F.col("leader").alias("now")), "a", "left").select("a", "b", F.coalesce("leader", "now").alias("leader"))
        told = stored(told, "greedy-told")
        ready = told.groupBy("b").agg(F.count("*").alias("n"), F.count("leader").alias("known"), F.min("leader").alias("leader")).filter("n = known").select(F.col("b").alias("place"), "leader")
        ready.write.parquet(f"{settled}/round={turn + 1}")
        ready = spark.read.schema(ready.schema).parquet(f"{settled}/round={turn + 1}")
        left = stored(told.join(ready.select(F.col("place").alias("b")), "b", "left_anti"), "greedy-best")
        drop_stored(told, *([waiting] if turn else [best]))
        waiting, turn = left, turn + 1
    return spark.read.schema(front.schema).option("recursiveFileLookup", "true").parquet(settled)


def normalised(names: DataFrame, order: list[str], share: float = 0.8, name: str = "name", by_best: bool = False) -> DataFrame:
    """Each name with the one that a greedy pass in the given order would let it stand for.

    Returns the columns of ``names``, ``place`` (from 1, in the order) and ``leader_name``
    and ``leader``. A name joins the first leader before it that it resembles by
    ``share`` or more (edit similarity, case aside) or, ``by_best``, the group of the
    name before it that it resembles most. Null and empty names resemble nothing. Equal
    names are merged; ties of the order may go either way.
    """
    placed = stored(numbered(names, order, "place"), "greedy-names")
    distinct = placed.filter(F.length(name) > 0)
    firsts = distinct.groupBy(F.lower(name).alias("low")).agg(F.min("place").alias("place"))  # equal names need no pairs
    led = best_leaders(firsts, stored(alike(firsts, share, "low"), "greedy-edges")) if by_best else leaders(stored(firsts, "greedy-firsts"), share, "low")
    labelled = firsts.join(led, "place").select("low", "leader")
    own = placed.join(labelled, F.lower(placed[name]) == labelled["low"], "left").drop("low").withColumn("leader", F.coalesce("leader", "place"))
    titles = placed.select(F.col("place").alias("leader"), F.col(name).alias("leader_name"))
    return own.join(titles, "leader").select(*names.columns, "place", "leader", "leader_name")
