"""Admission of sign-ups with unique user names and e-mail addresses.

Read as a graph, every acceptable sign-up is an edge between a user name and an
address, and admitting them first come, first served is the greedy matching in
order of arrival. Each round admits the edges that come first at both ends and
drops the edges they block; the earliest edge left is always admitted, so the
loop ends by itself. On arrival orders unrelated to the graph the number of
rounds grows with the logarithm of the batch (Blelloch, Fineman and Shun, "Greedy
sequential maximal independent set and matching are parallel on average", 2012).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from fareline.functions import fixed_values as V
from fareline.functions.text import is_empty, sanitize, text_key
from fareline.session import enable_checkpoints, stored
from fareline.sources.schemas import TABLES
from fareline.sources.versions import Version, VersionedTables, Written, partition_name

REQUIRED = ["username", "first_name", "last_name", "email"]
OPTIONAL = ["phone_number", "address"]

# The rows admitted so far are written out again after this many rounds, to keep plans short.
ROUNDS_PER_FOLD = 16


class Admission(NamedTuple):
    users: DataFrame
    rejects: DataFrame


def _first_come(candidates: DataFrame) -> DataFrame:
    """Admit ``(name_key, mail_key, at)`` rows greedily by ``at``; both keys end up unique."""
    # A later row with the same two keys can never get in, so one row per pair is enough.
    left = candidates.groupBy("name_key", "mail_key").agg(F.min("at").alias("at")).checkpoint()
    admitted = left.filter(F.lit(False))
    rounds = 0
    while not left.isEmpty():
        edge = F.struct("at", "name_key", "mail_key")
        by_name = left.groupBy("name_key").agg(F.min(edge).alias("e")).select("e.*")
        by_mail = left.groupBy("mail_key").agg(F.min(edge).alias("e")).select("e.*")
        both = by_name.join(by_mail, ["name_key", "mail_key", "at"]).checkpoint()
        left = (
            left.join(both.select("name_key"), "name_key", "left_anti")
            .join(both.select("mail_key"), "mail_key", "left_anti")
            .checkpoint()
        )
        admitted = admitted.unionByName(both)
        rounds += 1
        if rounds % ROUNDS_PER_FOLD == 0:
            admitted = admitted.checkpoint()
    return admitted


def _of_batch(held: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Those of the held keys that the batch has; a small batch is sent to the keys."""
    return held.select(key).join(batch.select(key).distinct(), key, "left_semi").distinct()


def _known(users: DataFrame, column: str, batch: DataFrame, key: str) -> DataFrame:
    """The keys of the batch that users already have."""
    return _of_batch(users.select(text_key(F.col(column)).alias(key)), batch, key)


def keyed_forms(regs: DataFrame) -> DataFrame:
    """The cleaned forms with their order of arrival ``at`` and what their names compare by."""
    optional = [
        (sanitize(F.col(c)) if c in regs.columns else F.lit(None).cast("string")).alias(c)
        for c in OPTIONAL
    ]
    at = F.struct("ts", "reg_id").alias("at")
    clean = regs.select("reg_id", at, *[sanitize(F.col(c)).alias(c) for c in REQUIRED], *optional)
    incomplete: Column = F.lit(False)
    for name in REQUIRED:
        incomplete = incomplete | is_empty(F.col(name))
    return clean.withColumns(
        {
            "name_key": text_key(F.col("username")),
            "mail_key": text_key(F.col("email")),
            "incomplete": incomplete,
        }
    )


def judged_forms(keyed: DataFrame, known_names: DataFrame, known_mails: DataFrame) -> DataFrame:
    """The forms of a batch with every reason against them; none for the admitted ones.

    Only admitted rows take a name or address: a refused sign-up never blocks a later one.
    """
    # Stored, so that forms under one name or address can be spread over tasks.
    names = stored(known_names, "known").withColumn("name_known", F.lit(1))
    mails = stored(known_mails, "known").withColumn("mail_known", F.lit(1))
    # Read by the rounds and again for the verdicts; the users are scanned only here.
    checked = keyed.join(names, "name_key", "left").join(mails, "mail_key", "left").checkpoint()
    open_rows = checked.filter(
        ~F.col("incomplete") & F.col("name_known").isNull() & F.col("mail_known").isNull()
    )
    admitted = _first_come(open_rows.select("name_key", "mail_key", "at"))

    taken_names = admitted.select("name_key", F.col("at").alias("name_at"))
    taken_mails = admitted.select("mail_key", F.col("at").alias("mail_at"))
    judged = checked.join(taken_names, "name_key", "left").join(taken_mails, "mail_key", "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("incomplete"), V.REASON_REQUIRED),
            F.when(F.col("name_known").isNotNull() | (F.col("name_at") < F.col("at")), V.REASON_USERNAME),
            F.when(F.col("mail_known").isNotNull() | (F.col("mail_at") < F.col("at")), V.REASON_EMAIL),
        )
    )
    return judged.withColumn("reasons", reasons)


def _as_users(judged: DataFrame, first_id: Column) -> DataFrame:
    return judged.filter(F.size("reasons") == 0).select(
        (first_id + F.col("reg_id")).alias("user_id"),
        *REQUIRED,
        *OPTIONAL,
        F.lit(0).alias("is_admin"),
        F.lit(1).alias("is_active"),
        F.to_date("at.ts").alias("created_at"),
    )


def _refused(judged: DataFrame) -> DataFrame:
    return judged.filter(F.size("reasons") > 0).select("reg_id", "reasons")


def admit_users(users: DataFrame, regs: DataFrame) -> Admission:
    """Add the acceptable sign-ups as users and give every reason against the others.

    Names and addresses compare without regard to case and accents.
    """
    enable_checkpoints(users.sparkSession)
    keyed = keyed_forms(regs)
    judged = judged_forms(
        keyed, _known(users, "username", keyed, "name_key"), _known(users, "email", keyed, "mail_key")
    )
    next_id = F.coalesce(users.agg(F.max("user_id")).scalar(), F.lit(-1)) + 1
    return Admission(users.unionByName(_as_users(judged, next_id)), _refused(judged))


# ---- sign-ups that arrive over time ------------------------------------------

#: Keys are stored in buckets by their hash; a batch reads those that its forms fall into. A desk gets
#: a bucket for so many users it starts with, within these bounds.
BUCKET_USERS = 1 << 16
FEWEST_BUCKETS, BUCKETS = 16, 1024
#: The files of a bucket are put together beyond this many commits.
PARTS = 20

DESK = {
    "users": TABLES["users"],
    "rejects": StructType([StructField("reg_id", LongType()), StructField("reasons", ArrayType(StringType()))]),
    "names": StructType([StructField("name_key", StringType()), StructField("bucket", IntegerType())]),
    "mails": StructType([StructField("mail_key", StringType()), StructField("bucket", IntegerType())]),
}


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def _buckets_of(version: Version) -> int:
    return version.notes.get("buckets", BUCKETS)


class SignupDesk:
    """Users, and the names and addresses that are taken, as stored tables that sign-ups extend.

    The users a batch adds and the names and addresses they take appear in one version (see
    ``fareline.sources.versions``), with the number of the batch: a repeated one is passed
    over. Batches in order of arrival give what :func:`admit_users` gives for all of them.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.tables = VersionedTables(spark, folder, DESK, {"names": "bucket", "mails": "bucket"})

    @classmethod
    def create(cls, spark: SparkSession, folder: str, users: DataFrame) -> SignupDesk:
        desk = cls(spark, folder)
        highest, n = users.agg(F.max("user_id"), F.count(F.lit(1))).first()
        buckets = min(BUCKETS, max(FEWEST_BUCKETS, -(-n // BUCKET_USERS)))
        written = [desk.tables.write("users", users), *desk._taken(users, buckets)]
        # Ids go on from the users at the start, so that they do not depend on the batches.
        desk.tables.publish(desk.tables.open(), written, first_id=0 if highest is None else highest + 1, buckets=buckets)
        return desk

    def _taken(self, users: DataFrame, buckets: int) -> list[Written]:
        out = []
        for table, column, key in (("names", "username", "name_key"), ("mails", "email", "mail_key")):
            keys = users.select(text_key(F.col(column)).alias(key)).filter(F.col(key).isNotNull()).distinct()
            out.append(self.tables.write(table, keys.select(key, _bucket(key, buckets))))
        return out

    def _held(self, version: Version, table: str, key: str, batch: DataFrame) -> DataFrame:
        bucket = _bucket(key, _buckets_of(version))
        buckets = [partition_name("bucket", r[0]) for r in batch.select(bucket).distinct().collect()]
        return _of_batch(self.tables.read(version, table, buckets), batch, key)

    def admit(self, regs: DataFrame, batch: int | None = None) -> Version:
        """Judge a batch of sign-ups against the users so far and each other."""
        version = self.tables.open()
        if batch is not None and batch <= version.notes.get("batch", -1):
            return version
        enable_checkpoints(regs.sparkSession)
        # Dealt out first: cleaning takes most of the time, and a batch may come as one file.
        keyed = stored(keyed_forms(regs.repartition("reg_id")), "forms")
        judged = judged_forms(
            keyed, self._held(version, "names", "name_key", keyed), self._held(version, "mails", "mail_key", keyed)
        )
        judged = stored(judged, "judged-forms")
        users = _as_users(judged, F.lit(version.notes["first_id"]))
        written = [self.tables.write("users", users), self.tables.write("rejects", _refused(judged))]
        written += self._taken(users, _buckets_of(version))
        version = self.tables.publish(version, written, **({} if batch is None else {"batch": batch}))
        return self._put_together(version)

    def _put_together(self, version: Version) -> Version:
        written = []
        for table in DESK:
            many = [p for p, commits in version.parts.get(table, {}).items() if len(commits) > PARTS]
            if many:
                written.append(self.tables.write(table, self.tables.read(version, table, many), many))
        return self.tables.publish(version, written) if written else version

    def follow(self, regs: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Admit a stream of sign-ups, a commit per micro-batch."""

        def write(batch: DataFrame, number: int) -> None:
            self.admit(batch, number)

        return (
            regs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
        )

    def users(self, version: Version | None = None) -> DataFrame:
        return self.tables.read(version or self.tables.open(), "users")

    def rejects(self, version: Version | None = None) -> DataFrame:
        return self.tables.read(version or self.tables.open(), "rejects")
