"""Batch search: a table of questions against all entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import vn_normalize
from ..storage import materialise

#: Tokens of a title are indexed by their runs of so many characters, so a question meets titles by an equi-join.
GRAM = 3
#: Runs of all questions up to which questions are broadcast; titles never are: Spark sizes them as if no title had been taken apart.
BROADCAST_RUNS = 100_000


def search(questions: DataFrame, entities: DataFrame, limit: int = 10) -> DataFrame:
    """questions(q), entities(kind, id, title, place) -> q, kind, id, title, rank.

    A title matches when its folded form contains the folded question. Candidates come from an equi-join on the run of
    characters of the question that the fewest titles have, so a run that most titles share is the key of questions only
    that consist of such runs. Shortest titles come first within a kind, `limit` of each; kinds follow their place, `limit`
    in all; both are kept down to the limit before they are shuffled.
    """
    asked = materialise(questions.select("q", vn_normalize(F.col("q")).alias("folded")).where("folded <> ''").distinct(), "questions")
    titled = entities.withColumn("norm", vn_normalize(F.col("title")))
    runs_of = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - GRAM + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(GRAM))))
    grams = asked.where(F.length("folded") >= GRAM).withColumn("gram", F.explode(runs_of("folded")))
    few = grams.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS and asked.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS
    small = F.broadcast if few else lambda df: df.hint("merge")
    had = titled.select(F.explode(runs_of("norm")).alias("gram")).join(small(grams.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("titles"))
    rarest = F.min(F.struct(F.coalesce("titles", F.lit(0)).alias("titles"), "gram")).alias("rarest")
    long_q = grams.join(had, "gram", "left").groupBy("q", "folded").agg(rarest).where("rarest.titles > 0").select("q", "folded", "rarest.gram")
    short_q = asked.where(F.length("folded") < GRAM)
    hits = titled.withColumn("gram", F.explode(runs_of("norm"))).join(small(long_q), "gram").where(F.contains("norm", "folded")).select("q", "kind", "id", "title", "norm", "place")
    if not short_q.isEmpty():  # one or two characters: indexed by single and double characters
        pieces = F.array_distinct(F.concat(*[F.transform(F.sequence(F.lit(1), F.greatest(F.length("norm"), F.lit(1))), lambda i: F.substring("norm", i, F.lit(1)))], *[F.transform(F.sequence(F.lit(1), F.greatest(F.length("norm") - 1, F.lit(1))), lambda i: F.substring("norm", i, F.lit(2)))]))
        hits = hits.unionByName(titled.withColumn("folded", F.explode(pieces)).join(small(short_q), "folded").select("q", "kind", "id", "title", "norm", "place"))
    in_kind = hits.withColumn("k", F.row_number().over(Window.partitionBy("q", "kind").orderBy(F.length("norm"), "id"))).where(F.col("k") <= limit)
    return in_kind.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("place", "k"))).where(F.col("rank") <= limit).select("q", "kind", "id", "title", "rank")


def with_geocoder(questions: DataFrame, found: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Questions without a hit take the gazetteer's."""
    spare = gazetteer.withColumnRenamed("title", "spare")
    return questions.join(found, "q", "left").join(spare, "q", "left").select("q", F.coalesce("title", "spare").alias("title"))
