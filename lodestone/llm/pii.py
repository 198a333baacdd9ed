"""Personal data by fixed forms and bootstrapped contextual extraction, in DataFrame operations only.

Fixed forms give the base spans. Those are also the seeds of a bootstrap: the words
around seeds are patterns, patterns and the strings they surround form a graph, and
scores flow over it. A pattern is trusted as far as the strings it surrounds are, a
string as far as its patterns are; a string that is all but certain counts as a
seed in the next round, and rounds go on until the scores settle. Trusted patterns
so discover identifiers of other forms: any run of letters and digits with a digit
in it, also in groups. Words without a digit, such as names, are no candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import drop_stored, fresh, row_key, stored

#: Kinds of base spans in the order they are listed, and of the spans that are discovered.
KINDS = ("email", "ip", "card", "phone", "context")
LOCAL = "[A-Za-z0-9._%+-]"
#: The base forms for a matcher that backtracks. Repeats that can't give anything back are possessive, and a match
#: starts at the end of the last one or at the start of a run: the same matches, in time linear in the text.
FORMS = (
    rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![A-Za-z0-9._%+@#-])(?=[A-Za-z0-9_#/.-]{4})(?=[A-Za-z_#/.-]{0,40}[0-9])[#]?[A-Za-z0-9]++(?:[-_#/.][A-Za-z0-9]++)*+(?:\x20[0-9]{2,4}+(?![A-Za-z0-9.,@-]))*+(?![A-Za-z0-9@])",
)
#: A text without this part of a form holds no match of it.
SIGNS = ("@", ".", "", "+", "")
#: Characters that a discovered identifier has at least.
LEAST_LENGTH = 4
#: Score from which a discovered string counts as a seed, and what no discovered string exceeds.
CERTAIN, MOST = 0.95, 0.99
#: A rise of a score that no longer counts.
SETTLED = 0.001
#: Of a card's 16 to 19 digits and a phone's 8 to 15.
CARD_DIGITS, PHONE_DIGITS = (16, 19), (8, 15)
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
LEFT = r"(\p{L}+)[^\p{L}0-9]{1,3}(\p{L}+)[^\p{L}0-9]{0,3}$"
RIGHT = r"^[^\p{L}0-9]{0,3}(\p{L}+)"
#: A word that names what follows it.
LABEL = r"(\p{L}{2,})[\x20]?[:=#][\x20]?$"


def _entries(text: Column, kind: int) -> Column:
    """Matches of a form with what stands before and after each; what is before it is kept by its length."""
    form = FORMS[kind]
    pieces, matches = F.split(text, form, -1), F.regexp_extract_all(text, F.lit(form), F.lit(0))
    # side by side, so that the text is cut once and not for every match
    beside = F.arrays_zip(matches, F.slice(pieces, F.lit(1), F.size(matches)), F.slice(pieces, F.lit(2), F.size(matches)))

    def entry(match: Column, i: Column) -> Column:
        before, after = match.getField("1"), match.getField("2")
        # no span is so long that 80 characters of context reach past the words next to it
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(before).alias("gap"), match.getField("0").alias("match"), F.substring(before, -80, 80).alias("left"), F.substring(after, 1, 40).alias("right"))

    found = F.transform(beside, entry)
    there = text.rlike(form) if not SIGNS[kind] else text.contains(SIGNS[kind]) & text.rlike(form)
    return F.when(there, found).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,match:string,left:string,right:string>>"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _stands(kind: Column, match: Column) -> Column:
    """Whether a match meets its form's conditions."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return F.when(kind == 1, match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")).when(kind == 2, F.when(n.between(*CARD_DIGITS), luhn(digits)).otherwise(False)).when(kind == 3, n.between(*PHONE_DIGITS)).when(kind == 4, F.length(match) >= LEAST_LENGTH).otherwise(True)


def _trusted(edges: DataFrame, least_seeds: int, least_trust: float) -> DataFrame:
    """Strings that patterns vouch for: distinct ``instance`` of the unlisted ones.

    Scores only ever rise, and are bounded; rounds go on until none rises by more than ``SETTLED``.
    """
    scores = stored(edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score")), "pii-scores")
    while True:
        scored = edges.select("pattern", "instance").join(scores, "instance")
        patterns = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("trust"), F.sum((F.col("score") >= CERTAIN).cast("int")).alias("seeds")).filter((F.col("seeds") >= least_seeds) & (F.col("trust") >= least_trust))
        raised = edges.filter(~F.col("seed")).select("pattern", "instance").join(patterns, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("trust"))))).alias("raised"))
        before = scores
        after = F.greatest("score", F.least(F.coalesce("raised", F.lit(0.0)), F.lit(MOST)))
        scores = stored(before.join(raised, "instance", "left").select("instance", after.alias("score"), (after - F.col("score") > SETTLED).alias("rose")), "pii-scores")
        drop_stored(before)
        if scores.filter("rose").isEmpty():
            return scores.filter((F.col("score") >= least_trust) & (F.col("score") < 1)).select("instance")


def find_spans(docs: DataFrame, least_seeds: int = 3, least_trust: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` (id and ``row``), and spans: ``row``, ``kind`` (its place in KINDS), ``start``, ``end``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit("").alias("match"), F.lit("").alias("left"), F.lit("").alias("right"))
    read = docs.select(F.col(id_col), row_key(id_col, text_col).alias("row"), F.explode(F.concat(F.array(row), *(_entries(text, kind) for kind in range(len(FORMS))))).alias("e"))
    met = stored(read.select(id_col, "row", "e.*"), "pii-matches")
    # the matches of a text are as many as its length allows; one exchange serves all that follows
    matches = met.filter("kind >= 0").drop(id_col).repartition("row").dropDuplicates(["row", "kind", "i"])
    along = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("match")).over(along)
    placed = matches.withColumn("end", end).withColumn("start", F.col("end") - F.length("match")).filter(_stands(F.col("kind"), F.col("match")))
    # identifiers that a base span overlaps are known already
    is_base = F.col("kind") < 4
    sides = Window.partitionBy("row").orderBy("start", "kind")
    reach = F.max(F.when(is_base, F.col("end"))).over(sides.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(is_base, F.col("start"))).over(sides.rowsBetween(1, Window.unboundedFollowing))
    spans = placed.withColumn("reach", reach).withColumn("ahead", ahead).filter(is_base | ((F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end"))))
    spans = stored(spans.select("row", "kind", "start", "end", F.lower("match").alias("instance"), F.lower("left").alias("left"), F.lower("right").alias("right")), "pii-spans")

    words = lambda i: F.regexp_extract("left", LEFT, i)
    after = F.regexp_extract("right", RIGHT, 1)
    label = F.regexp_extract("left", LABEL, 1)
    patterns = F.array(F.when(label != "", F.concat(label, F.lit(": _"))), F.when(words(2) != "", F.concat(words(1), F.lit(" "), words(2), F.lit(" _"))), F.when((words(2) != "") & (after != ""), F.concat(words(2), F.lit(" _ "), after)))
    edges = spans.select(F.explode(patterns).alias("pattern"), "instance", is_base.alias("seed")).filter("pattern is not null").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    trusted = _trusted(stored(edges, "pii-graph"), least_seeds, least_trust)
    found = spans.filter(is_base).unionByName(spans.filter(~is_base).join(trusted, "instance", "left_semi").select(spans.columns))
    return met.filter("kind < 0").select(id_col, "row"), found.select("row", "kind", "start", "end")


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bootstrap: float) -> DataFrame:
    """Personal data of every text.

    Returns a row for each row of ``docs``: its id; ``n_email``, ``n_ip``,
    ``n_card`` and ``n_phone``, the numbers of base spans; ``base_sha256``, of the
    base spans as kind:start:end by kind and start, joined by commas; ``spans``,
    all spans so written; and ``n_context``, those the bootstrap discovered.
    Offsets are code points, ends exclusive. Whole texts are read, however long. A
    null text is an empty text; repeated rows give repeated results; other columns
    are ignored; an empty table gives none.
    """
    rows, spans = find_spans(docs, id_col=id_col, text_col=text_col, **bootstrap)
    listed = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("all"))
    own = F.coalesce(F.col("all"), F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))
    of = lambda kind: F.size(F.filter(own, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(own, lambda s: s["kind"] < 4)
    return rows.join(listed, "row", "left").select(id_col, *(of(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])), F.sha2(_written(base), 256).alias("base_sha256"), _written(own).alias("spans"), of(4).alias("n_context"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bootstrap: float) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets.

    All columns stay, whatever their names; only the text changes, and only where there are spans.
    Spans that overlap are replaced as one, named after the first.
    """
    _, spans = find_spans(docs, id_col=id_col, text_col=text_col, **bootstrap)
    sides = Window.partitionBy("row").orderBy("start", "kind")
    apart = F.coalesce(F.col("start") >= F.max("end").over(sides.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    merged = spans.withColumn("group", F.sum(apart.cast("int")).over(sides)).groupBy("row", "group").agg(F.min(F.struct("start", "kind")).alias("first"), F.max("end").alias("end"))
    cuts = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("first.start").alias("start"), "end", F.col("first.kind").alias("kind")))).alias("cuts"))
    names = F.array(*(F.lit(f"[{name.upper()}]") for name in KINDS))
    own, at = fresh(docs, "own_row"), fresh(docs, "own_cuts")
    text, parts = F.col(text_col), F.col(at)

    def part(cut: Column, i: Column) -> Column:
        since = F.when(i == 0, F.lit(0)).otherwise(F.get(parts, i - 1)["end"])
        return F.concat(F.substring(text, (since + 1).cast("int"), (cut["start"] - since).cast("int")), F.get(names, cut["kind"]))

    rest = F.substring(text, (F.element_at(parts, -1)["end"] + 1).cast("int"), F.length(text))
    cleaned = F.when(parts.isNull(), text).otherwise(F.concat(F.array_join(F.transform(parts, part), ""), rest))
    keyed = docs.withColumn(own, row_key(id_col, text_col))
    return keyed.join(cuts.select(F.col("row").alias(own), F.col("cuts").alias(at)), own, "left").select(*(cleaned.alias(c) if c == text_col else F.col(c) for c in docs.columns))
