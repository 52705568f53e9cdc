"""Sign-ups that arrive over time against the same sign-ups in one batch."""

import os
import random

import pytest
from pyspark.sql import functions as F

from fareline.operators import signups
from fareline.session import work_folder
from fareline.streaming import live
from tests.test_signups import regs
from tests.tiny import dicts, frame

KNOWN = [("Ann", "ann@x"), ("José", "jose@x"), ("b", None)]


def known_users(spark):
    return frame(spark, "users", [{"user_id": i, "username": u, "email": e} for i, (u, e) in enumerate(KNOWN)])


def made(seed, n=120):
    rng = random.Random(seed)
    names = [f"{x}{i}" for i in range(12) for x in ("u", "U", "ü")] + ["jose", "ann", "", None]
    mails = [f"{x}{i}@x" for i in range(25) for x in ("m", "M", "ḿ")] + ["ANN@X", "0"]
    return [(i, i // 2, rng.choice(names), "F", rng.choice(["L", "L", "L", "0"]), rng.choice(mails)) for i in range(n)]


def rows(df, *columns):
    return sorted((str([r[c] for c in columns]) for r in dicts(df)))


def same(desk, users, batch):
    names = users.columns
    assert rows(desk.users(), *names) == rows(batch.users, *names)
    assert rows(desk.rejects(), "reg_id", "reasons") == rows(batch.rejects, "reg_id", "reasons")


@pytest.mark.parametrize("seed, cuts", [(1, [0, 120]), (2, [0, 1, 40, 41, 120])])
def test_any_split_in_order_of_arrival_gives_the_batch_result(spark, seed, cuts):
    users, forms = known_users(spark), made(seed)
    desk = signups.SignupDesk.create(spark, work_folder(spark, "desk"), users)
    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
        desk.admit(regs(spark, forms[low:high]), k)
        desk.admit(regs(spark, forms[low:high]), k)  # a batch that comes again
    same(desk, users, signups.admit_users(users, regs(spark, forms)))


def test_a_stream_of_files_and_a_crash(spark, tmp_path, monkeypatch):
    users, forms = known_users(spark), made(3)
    arriving = str(tmp_path / "forms")
    for low in (0, 50, 90):
        regs(spark, forms[low : {0: 50, 50: 90, 90: 120}[low]]).coalesce(1).write.mode("append").parquet(arriving)
    desk = signups.SignupDesk.create(spark, str(tmp_path / "desk"), users)
    stream = live.file_stream(spark, arriving, regs(spark, []).schema, files_per_batch=1)
    publish, calls = signups.VersionedTables.publish, []

    def once(self, base, written, **notes):
        calls.append(notes)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return publish(self, base, written, **notes)

    monkeypatch.setattr(signups.VersionedTables, "publish", once)
    with pytest.raises(Exception, match="lost"):
        desk.follow(stream, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    assert desk.tables.open().notes["batch"] == 0
    desk.follow(stream, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    assert desk.tables.open().notes["batch"] == 2
    same(desk, users, signups.admit_users(users, regs(spark, forms)))


def test_a_batch_reads_the_buckets_of_its_forms(spark, monkeypatch):
    many = spark.range(3000).select(
        F.col("id").alias("user_id"), F.concat(F.lit("n"), "id").alias("username"), F.concat(F.lit("m"), "id").alias("email"),
        *[F.lit(None).cast("string").alias(c) for c in ("first_name", "last_name", "phone_number", "address")],
        F.lit(0).alias("is_admin"), F.lit(1).alias("is_active"), F.current_date().alias("created_at"),
    )
    monkeypatch.setattr(signups, "BUCKETS", 16)
    desk = signups.SignupDesk.create(spark, work_folder(spark, "desk"), many)
    keyed = signups.keyed_forms(regs(spark, [(1, 1, "N7", "F", "L", "m9")]))
    version = desk.tables.open()
    held = desk._held(version, "names", "name_key", keyed)
    assert [r["name_key"] for r in held.collect()] == ["n7"]
    assert len({os.path.dirname(f) for f in held.inputFiles()}) == 1 < len(version.parts["names"])
    desk.admit(regs(spark, [(1, 1, "N7", "F", "L", "m9"), (2, 2, "fresh", "F", "L", "also")]))
    assert desk.users().count() == 3001
    assert [r["reasons"] for r in dicts(desk.rejects())] == [["Username already exists", "Email already exists"]]


def test_nobody_yet(spark):
    desk = signups.SignupDesk.create(spark, work_folder(spark, "desk"), known_users(spark).limit(0))
    desk.admit(regs(spark, [(0, 0, "A", "F", "L", "M"), (1, 1, "Á", "F", "L", "N")]))
    assert [r["user_id"] for r in dicts(desk.users())] == [0]
    desk.admit(regs(spark, []))
    assert desk.users().count() == 1


def test_buckets_follow_the_number_of_users(spark, monkeypatch):
    users = known_users(spark)
    desk = signups.SignupDesk.create(spark, work_folder(spark, "desk"), users)
    assert desk.tables.open().notes["buckets"] == signups.FEWEST_BUCKETS
    monkeypatch.setattr(signups, "BUCKET_USERS", 1)
    monkeypatch.setattr(signups, "FEWEST_BUCKETS", 1)
    desk = signups.SignupDesk.create(spark, work_folder(spark, "desk"), users)
    assert desk.tables.open().notes["buckets"] == len(KNOWN)
    monkeypatch.undo()  # a desk keeps the buckets it was made with
    forms = made(4, 60)
    desk.admit(regs(spark, forms))
    same(desk, users, signups.admit_users(users, regs(spark, forms)))


def test_forms_of_one_file_are_cleaned_by_several_tasks(spark, monkeypatch):
    desk = signups.SignupDesk.create(spark, work_folder(spark, "desk"), known_users(spark))
    spread, keyed_forms = [], signups.keyed_forms
    monkeypatch.setattr(signups, "keyed_forms", lambda df: spread.append(df.rdd.getNumPartitions()) or keyed_forms(df))
    monkeypatch.setattr(signups, "stored", lambda df, purpose: df.checkpoint())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        desk.admit(regs(spark, made(5)).coalesce(1))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread[0] > 1
