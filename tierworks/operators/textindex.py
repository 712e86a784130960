"""A stored inverted index of short texts: which text holds which three bytes where, and which tag.

A posting is (gram, id, at): a gram is three consecutive bytes of the lower-cased text in UTF-8, with two
zero bytes after the end, so every place of a text begins one; ``at`` lists the places. Tags are postings without
places. Bytes of a text hold those of a pattern exactly where the text holds the pattern, so a pattern is
found from the postings of grams that cover it, place by place, and no text is read. Postings are
sorted by gram and id: a lookup of known grams reads the row groups that hold them.

Texts are never cut; a NULL text has no postings; ids must differ and not be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 3
SHORT = 2  # longest term that has to be a word of its own
TAG = "tag:"  # longer than a gram, so it meets none


def as_bytes(text: Column) -> Column:
    """The lower-cased text with one character for each byte of its UTF-8."""
    return F.decode(F.encode(F.lower(text), "UTF-8"), "ISO-8859-1")


def grams(text: Column) -> Column:
    """All grams of a text in order of their places."""
    return whole_grams(F.concat(as_bytes(text), F.lit("\0" * (SIZE - 1))))


def pattern_grams(pattern: str) -> dict[int, str]:
    """Place and gram of as few grams as cover the pattern's bytes; a shorter pattern is its own, an incomplete one."""
    raw = pattern.lower().encode().decode("latin-1")
    places = sorted({*range(0, max(1, len(raw) - SIZE + 1), SIZE), max(0, len(raw) - SIZE)})
    return {i: raw[i : i + SIZE] for i in places}


@dataclass(frozen=True)
class TextIndex:
    """The index in a folder that all executors reach: postings, how many texts hold each gram, and the texts."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, rows: DataFrame, path: str, tags: Column | None = None) -> TextIndex:
        """Index rows of (id, text, ...); ``tags`` is an array column of tags, other columns are kept with the texts."""
        spark, own = rows.sparkSession, [c for c in rows.columns if c not in ("id", "text")]
        none = F.array().cast("array<string>")
        marks = none if tags is None else F.coalesce(tags, none)
        kept = rows.where(F.col("id").isNotNull()).select("id", "text", *own, marks.alias("tags"))
        kept.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/texts")
        kept = spark.read.parquet(f"{path}/texts")
        # the places of a gram in one text come from one row, so they are gathered before anything moves
        placed = kept.select("id", F.posexplode(grams(F.col("text"))).alias("place", "gram"))
        found = placed.groupBy("gram", "id").agg(F.sort_array(F.collect_list("place")).alias("at"))
        tagged = kept.select(F.explode(F.array_distinct("tags")).alias("tag"), "id").select(
            F.concat(F.lit(TAG), "tag").alias("gram"), "id", F.array().cast("array<int>").alias("at")
        )
        postings = found.unionByName(tagged.where(F.col("gram").isNotNull()))
        postings.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{path}/postings")
        counts = spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
        return cls(spark, path)

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def postings(self, gram: str | None = None) -> DataFrame:
        """All postings, or those of one gram or tag."""
        rows = self.spark.read.parquet(f"{self.path}/postings")
        return rows if gram is None else rows.where(F.col("gram") == gram)

    def counts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/counts")

    def holding(self, pattern: str) -> DataFrame:
        """Ids of the texts that hold the pattern, from the postings of its grams alone."""
        parts = pattern_grams(pattern)
        if not pattern:
            return self.texts().select("id")
        if len(parts[0]) < SIZE:
            return self.postings().where(F.startswith("gram", F.lit(parts[0])) & (F.size("at") > 0)).select("id").distinct()
        # the rarest gram first: the others are met by what is left
        known = {r["gram"]: r["texts"] for r in self.counts().where(F.col("gram").isin(list(set(parts.values())))).collect()}
        order = sorted(parts, key=lambda i: (known.get(parts[i], 0), i))
        found = None
        for i in order:
            here = self._begins(parts[i], i)
            if found is None:
                found = here
            else:
                both = found.join(here.withColumnRenamed("begins", "more"), "id")
                found = both.select("id", F.array_intersect("begins", "more").alias("begins")).where(F.size("begins") > 0)
        return found.select("id")

    def _begins(self, gram: str, offset: int) -> DataFrame:
        """Where a pattern would begin that has the gram at an offset."""
        return self.postings(gram).select("id", F.transform("at", lambda p: p - offset).alias("begins"))

    def page(self, pattern: str | None = None, tags: Sequence[str] = (), limit: int = 50, after: str | None = None) -> DataFrame:
        """The first ``limit`` texts, in order of their ids and after the id given, that hold the pattern and all tags.

        The ids come from postings; then the texts of the page alone are read. Nothing before ``after`` is.
        """
        lists = [self.holding(pattern)] if pattern else []
        lists += [self.postings(TAG + t).select("id") for t in tags]
        ids = lists[0] if lists else self.texts().select("id")
        for more in lists[1:]:
            ids = ids.join(more, "id", "left_semi")
        if after is not None:
            ids = ids.where(F.col("id") > after)
        found = [r["id"] for r in ids.orderBy("id").limit(limit).collect()]
        return self.texts().where(F.col("id").isin(found)).drop("tags").orderBy("id")

    def links(self, terms: DataFrame) -> DataFrame:
        """Distinct (term, id): the texts that hold one of a term's aliases, for any number of (term, alias) rows.

        An alias of up to two characters has to be a word of its own, a longer one may be part of one. A short alias is
        looked up by its rarest gram; the texts found are then searched for it. Longer ones meet the texts by what
        the texts hold, see :meth:`parts`, so aliases that share their grams do not meet each other's texts.
        """
        wanted = terms.select("term", F.lower("alias").alias("alias")).where(F.length("alias") > 0).distinct()
        long = wanted.where(F.length("alias") > SHORT).select("term", as_bytes(F.col("alias")).alias("part"))
        whole = self.parts(long.select("part").distinct()).join(long, "part").select("term", "id").distinct()
        wanted = wanted.where(F.length("alias") <= SHORT)
        raw, counts = as_bytes(F.col("alias")), self.counts().where(F.length("gram") == SIZE)
        keyed = wanted.where(F.octet_length("alias") >= SIZE).withColumn("gram", F.explode(F.array_distinct(whole_grams(raw))))
        frequency = counts.join(keyed.select("gram").distinct(), "gram", "left_semi")
        # an alias with a gram that no text holds is in no text
        rarest = (
            keyed.join(frequency, "gram", "left").groupBy("term", "alias")
            .agg(F.min_by("gram", F.struct("texts", "gram")).alias("gram"), F.count_if(F.col("texts").isNull()).alias("unknown"))
            .where("unknown = 0").drop("unknown")
        )
        # an alias of one or two bytes is looked up by every gram that begins with it and then ends the word
        begins = counts.select("gram", F.explode(F.array(*[F.struct(F.substring("gram", 1, n).alias("start"), F.substring("gram", n + 1, 1).alias("next")) for n in range(1, SIZE)])).alias("b"))
        begins = begins.where(~F.rlike("b.next", F.lit("[a-z0-9]"))).select("gram", "b.start")
        tiny = wanted.where(F.octet_length("alias") < SIZE).withColumn("start", raw).join(begins, "start").select("term", "alias", "gram")
        best = rarest.unionByName(tiny)
        candidates = self.postings().select("gram", "id").join(best, "gram").select("term", "alias", "id").distinct()
        text = F.lower("text")
        holds = F.rlike(text, F.concat(F.lit(r"(^|[^a-z0-9])\Q"), F.replace("alias", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E([^a-z0-9]|$)")))
        short = candidates.join(self.texts().select("id", "text"), "id").where(holds).select("term", "id").distinct()
        return whole.unionByName(short)

    def parts(self, patterns: DataFrame) -> DataFrame:
        """Distinct (part, id): what the texts hold that begins like one of the patterns, rows of ``part``, and is as long.

        Postings meet the lengths wanted after each first gram, not the patterns, and a text is cut at those places alone: the
        work grows with the texts and the lengths there are, however many patterns begin alike.
        """
        lengths = patterns.groupBy(F.substring("part", 1, SIZE).alias("gram")).agg(F.collect_set(F.length("part")).alias("lengths"))
        spots = self.postings().join(lengths, "gram").groupBy("id").agg(F.collect_list(F.struct("at", "lengths")).alias("spots"))
        cut = self.texts().select("id", as_bytes(F.col("text")).alias("raw")).join(spots, "id")
        cut = cut.select("id", "raw", F.explode("spots").alias("s")).select("id", "raw", "s.lengths", F.explode("s.at").alias("at"))
        cut = cut.select("id", "raw", "at", F.explode("lengths").alias("length")).where(F.col("at") + F.col("length") <= F.length("raw"))
        return cut.select(F.substring(F.col("raw"), F.col("at") + 1, F.col("length")).alias("part"), "id").distinct()


def whole_grams(raw: Column) -> Column:
    """The grams that lie within a pattern's bytes."""
    return F.regexp_extract_all(raw, F.lit(f"(?s)(?=(.{{{SIZE}}}))"), F.lit(1))
