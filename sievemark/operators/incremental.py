"""Resolution kept up to date: a few added, corrected or removed mentions, without a full run.

The store holds mentions, their block keys and the clusters, each in folders by what it is
looked up by. Pairs are as many as the square of a strong block, so none is stored: those
that are asked for are made anew from the mentions and keys that make them. A change probes
the blocks of its mentions, scores them with their partners, and clusters anew the
components that its pairs touch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievemark.operators import judged, resolve
from sievemark.session import Scratch
from sievemark.sources.buckets import BUCKETS, BucketTable

#: No bound on name blocks, for keys that are known to make pairs.
_ANY = 2**31 - 1
_MENTION = ["mention_id", "doc_id", "name_raw", "dob", "elements"]


class ResolutionStore:
    """The state of a resolution under ``path``; the same rows as a full run over the mentions that it holds.

    ``mention_id`` is a string or a long, never null, once each. ``phonetic``, ``most`` and ``auto`` are those
    of the full run and must stay the same. Steps of a change are written in an order
    that lets the same change be applied again after a failure: clusters, keys, mentions.
    """

    def __init__(self, spark: SparkSession, path: str, mentions: DataFrame | None = None, phonetic: bool = True, most: int = resolve.MAX_NAME_BLOCK, auto: float = resolve.AUTO, buckets: int = BUCKETS):
        """Opens the store at ``path``, or with ``mentions (mention_id, doc_id, name_raw, dob, elements)`` builds it by a full run."""
        self.spark, self.phonetic, self.most, self.auto = spark, phonetic, most, auto
        raw = mentions if mentions is not None else spark.read.parquet(f"{path}/mentions").drop("_bucket")
        self._raw = raw.select(_MENTION).schema
        kind = self._raw["mention_id"].dataType
        self.mentions = BucketTable(spark, f"{path}/mentions", "mention_id", self._raw, buckets)
        self.keys = BucketTable(spark, f"{path}/keys", "key", StructType().add("key", "string").add("mention_id", kind).add("strong", "boolean"), buckets)
        # by "m" and mention: its cluster and component; by "c" and component: its mentions. One table, so that both change together
        self.places = BucketTable(spark, f"{path}/places", "entry", StructType().add("entry", "string").add("mention_id", kind).add("cluster_id", kind).add("component", kind), buckets)
        if mentions is not None:
            self._build(mentions.select(_MENTION))

    def _keys(self, raw: DataFrame) -> DataFrame:
        return resolve.block_keys(resolve.mentions_of(raw), self.phonetic)

    def _entries(self, placed: DataFrame) -> DataFrame:
        entry = F.explode(F.array(F.concat(F.lit("m"), F.col("mention_id").cast("string")), F.concat(F.lit("c"), F.col("component").cast("string"))))
        return placed.select(entry.alias("entry"), "mention_id", "cluster_id", "component")

    def _build(self, raw: DataFrame) -> None:
        scratch = Scratch(self.spark)
        raw = scratch.keep(raw, "store-mentions")
        made = resolve.written_mentions(raw)
        keys = scratch.keep(resolve.block_keys(made, self.phonetic), "store-keys")
        told = scratch.keep(judged.evidence(keys, made, self.most), "store-told")
        self.places.create(self._entries(scratch.keep(judged.clusters(told, raw, self.auto), "store-placed")))
        self.keys.create(keys)
        self.mentions.create(raw)

    def _pairable(self, rows: DataFrame) -> DataFrame:
        """The keys of ``rows`` that make pairs, as in a full run."""
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("strong").alias("strong"))
        return sizes.where((F.col("n") >= 2) & (F.col("strong") | (F.col("n") <= self.most))).select("key")

    def _usable(self, rows: DataFrame) -> DataFrame:
        """Those of all rows of some keys whose key makes pairs."""
        return rows.join(self._pairable(rows), "key", "left_semi").select("mention_id", "key", "strong")

    def apply(self, changed: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
        """Takes in added and corrected mentions, and drops those of ``removed (mention_id)``; returns the new ``(mention_id, cluster_id)`` of all that were clustered anew.

        A mention in both is removed. Read are the blocks of the old and new keys of these
        mentions and, where one of them passes the bound on name blocks either way, of its
        members; the mentions that share them; and the components that the pairs touch.
        Applying a change twice is applying it once.
        """
        scratch = Scratch(self.spark)
        keep = lambda name, df: scratch.keep(df, f"store-{name}")
        none = self.spark.createDataFrame([], self._raw)
        gone = keep("removed", (none if removed is None else removed).select(F.col("mention_id").cast(self._raw["mention_id"].dataType)).where("mention_id is not null").distinct())
        new = keep("new", (none if changed is None else changed).select(_MENTION).where("mention_id is not null").join(gone, "mention_id", "left_anti").to(self._raw))
        ids = keep("ids", new.select("mention_id").union(gone).distinct())
        old_keys, new_keys = keep("old-keys", self._keys(self.mentions.read(ids))), keep("new-keys", self._keys(new))

        # name blocks that pass the bound, either way: their members' pairs change too
        touched = keep("touched", old_keys.select("key").union(new_keys.select("key")).distinct())
        before = keep("before", self.keys.read(touched).join(ids, "mention_id", "left_anti").unionByName(old_keys.join(touched, "key", "left_semi")))
        after = before.join(ids, "mention_id", "left_anti").unionByName(new_keys)
        size = lambda df, n: df.where("not strong").groupBy("key").agg(F.count(F.lit(1)).alias(n))
        passed = size(before, "was").join(size(after, "now"), "key", "full").where((F.coalesce("was", F.lit(0)) > self.most) != (F.coalesce("now", F.lit(0)) > self.most))
        members = keep("members", after.join(passed, "key", "left_semi").join(ids, "mention_id", "left_anti").select("mention_id").distinct())

        # links that the change makes, then the components they touch
        anew = keep("anew", ids.union(members))
        member_keys = keep("member-keys", self._keys(self.mentions.read(members)))
        probed = keep("probed", touched.union(member_keys.select("key")).distinct())
        now = keep("now", self.keys.read(probed).join(ids, "mention_id", "left_anti").unionByName(new_keys))
        usable = keep("usable", self._usable(now))
        mark = anew.distinct().withColumn("fresh", F.lit(True))
        asked = usable.join(usable.join(mark, "mention_id", "left_semi").select("key").distinct(), "key", "left_semi")  # keys of these mentions alone
        met = self.mentions.read(asked.select("mention_id").distinct().join(ids, "mention_id", "left_anti")).unionByName(new)
        met = resolve.written_mentions(met.join(mark, "mention_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False))))
        linked = keep("linked", judged.linked(keep("told", judged.evidence(keep("asked", asked), met, _ANY)), self.auto))
        entry = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string")).alias("entry")
        torn = keep("torn", self.places.read(linked.union(anew).distinct().select(entry("m", "mention_id"))).select("component").distinct())
        held = keep("held", self.places.read(torn.select(entry("c", "component"))).select("mention_id").union(new.select("mention_id")).distinct().join(gone, "mention_id", "left_anti"))
        rows = resolve.written_mentions(self.mentions.read(held.join(ids, "mention_id", "left_anti")).unionByName(new))
        own_keys = keep("own-keys", resolve.block_keys(rows, self.phonetic))
        blocks = keep("blocks", self.keys.read(own_keys.select("key")).join(ids, "mention_id", "left_anti").unionByName(new_keys))
        told = keep("told", judged.evidence(keep("inside", self._usable(blocks).join(held, "mention_id", "left_semi")), rows, _ANY))
        placed = keep("placed", judged.clusters(told, held, self.auto))
        entries = keep("entries", self._entries(placed))
        spent = torn.select(entry("c", "component")).union(ids.select(entry("m", "mention_id"))).union(entries.select("entry")).distinct()
        self.places.replace(keep("spent", spent), entries)

        self.keys.replace(probed, now)
        self.mentions.replace(ids, new)
        return placed.select("mention_id", "cluster_id")

    def clusters(self, ids: DataFrame | None = None) -> DataFrame:
        """``(mention_id, cluster_id)`` of all mentions, or of ``ids (mention_id)`` by their folders alone."""
        entry = None if ids is None else ids.select(F.concat(F.lit("m"), F.col("mention_id").cast("string")).alias("entry"))
        return self.places.read(entry).where(F.col("entry").startswith("m")).select("mention_id", "cluster_id")

    def pairs(self) -> DataFrame:
        """``left_id < right_id`` and ``blocks`` of all candidate pairs, as ``resolve.candidate_pairs`` returns them; from the keys alone."""
        return resolve.candidate_pairs(self.keys.read(), self.most)

    def banded(self) -> DataFrame:
        """All scored pairs once, with clusters and bands, as ``resolve.cluster`` returns them; made anew, each mention taking its cluster along."""
        made = resolve.written_mentions(self.mentions.read().join(self.clusters().hint("shuffle_hash"), "mention_id"))
        return resolve.with_bands(resolve.score_pairs(resolve.candidate_features(self.keys.read(), made, self.most)), self.auto)
