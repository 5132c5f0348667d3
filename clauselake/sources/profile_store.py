"""Stored profiles, kept up by the signals of new rounds.

``entries/version=N`` holds the settled entries (``profile.settle_entries``) of the buckets of users that commit N touched,
``sources/version=N`` the signals that entered there, so that a load that comes again changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.operators import profile, session
from clauselake.operators.skew import lookup_join
from clauselake.runtime import written
from clauselake.sources.buckets import BucketStore, bucket_of

ENTRIES = "user_id long, field string, seq long, pos int, key string, value string"
_COLUMNS = ["user_id", "field", "seq", "pos", "key", "value"]


def due_signals(rounds: DataFrame, signals: DataFrame) -> DataFrame:
    """The signals of the rounds at which a profile is extracted: every third of a session (``session.every_nth_round``).

    ``rounds``: ``question_id, session_id, turn, ts_sec``; a signal's ``seq`` is its question.
    """
    due = session.every_nth_round(rounds).select(F.col("question_id").alias("seq"))
    return signals.join(due, "seq", "left_semi")


@dataclass(frozen=True)
class ProfileStore(BucketStore):
    """Profiles in long form, bucketed by user."""

    def entries(self) -> DataFrame:
        return self.current("entries", ENTRIES, "bucket int", self.state()[1]).drop("bucket")

    def merge(self, signals: DataFrame, resets: DataFrame | None = None) -> None:
        """Merge new signals (as ``profile.merge_profiles`` takes them); only the buckets of their users are read.

        ``resets`` (``user_id, reset_seq``) drops a user's stored entries and new signals up to the last reset.
        """
        fresh = profile.signal_entries(signals).select("user_id", "seq", "field", "pos", "key", "value")
        place = bucket_of(F.col("user_id"), self.buckets)
        fresh = written(fresh.withColumn("bucket", place), "new-entries")
        users = fresh.select("bucket").distinct()
        last = None
        if resets is not None:
            last = written(resets.groupBy("user_id").agg(F.max("reset_seq").alias("reset_seq")).withColumn("bucket", place), "resets")
            users = users.unionByName(last.select("bucket").distinct()).distinct()
        touched = sorted(r[0] for r in users.collect())  # at most ``buckets``
        if not touched:
            return
        commit, versions = self.state()
        before = {b: v for b, v in versions.items() if b in touched}
        old = self.current("entries", ENTRIES, "bucket int", before)
        seen = self.current("sources", "user_id long, seq long", "bucket int", before)
        # a signal enters once: what came in an earlier load is settled already
        fresh = fresh.join(seen.select("user_id", "seq"), ["user_id", "seq"], "left_anti")
        sources = seen.unionByName(fresh.select("user_id", "seq", "bucket")).distinct()
        every = old.select(*_COLUMNS).unionByName(fresh.select(*_COLUMNS))
        if last is not None:
            every = lookup_join(every, last.drop("bucket"), ["user_id"]).filter("reset_seq IS NULL OR seq > reset_seq").drop("reset_seq")
        settled = profile.settle_entries(every).withColumn("bucket", place)
        commit += 1
        self.write(settled.select(*_COLUMNS, "bucket"), "entries", commit)
        self.write(sources.select("user_id", "seq", "bucket"), "sources", commit)
        self.publish(commit, versions | dict.fromkeys(touched, commit))
