"""Conversations kept by a stream over several batches, against a plain fold."""

from datetime import datetime, timedelta

from pyspark.sql import types as T

from marlstone.streaming import conversation, funnel

START = datetime(2024, 1, 1)


def fold(turns, gap):
    out = {}
    for user, hours, failed, intent, colour, budget in turns:
        s = out.get(user)
        if s is None or hours - s["at"] > gap:
            s = out[user] = {"n": 0, "run": 0, "wishes": {}, "budgets": []}
        s["n"], s["run"], s["at"], s["intent"] = s["n"] + 1, s["run"] + 1 if failed else 0, hours, intent
        if colour:
            s["wishes"][colour] = s["wishes"].get(colour, 0) + 1
        if budget and budget > 0:
            s["budgets"] = [*s["budgets"], budget][-10:]
    return {u: (s["n"], s["run"], s["intent"], ";".join(f"colour:{c}={n}" for c, n in sorted(s["wishes"].items())), ";".join(f"{b:.2f}" for b in s["budgets"])) for u, s in out.items()}


def test_batches_and_forgetting(spark, tmp_path):
    """Turns over four batches: some users go on, one is silent and starts anew, one is never heard again; more than ten budgets, nulls, a null user."""
    conversation.state_store(spark)
    turns = [("a", 0.1 * i, i % 3 == 0, "ask", "red" if i % 2 else None, float(i)) for i in range(14)] + [("b", 0.5, True, "buy", "blue", 5.0), ("c", 1.0, None, None, "", None), (None, 1.2, False, "x", "red", -1.0)]
    turns += [("a", 3.0, True, "go on", "red", 99.0), ("b", 4.0, True, "again", "blue", None), ("c", 2.0, True, "y", "green", 1.0)]
    turns += [("b", 20.0, True, "anew", "green", 7.0), ("a", 8.5, False, "late", "red", None)]
    turns += [("b", 21.0, False, "last", "green", 8.0), ("d", 40.0, True, "first", None, None)]
    schema = T.StructType([T.StructField("user", T.StringType()), T.StructField("n", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("failed", T.BooleanType()), T.StructField("intent", T.StringType()), T.StructField("colour", T.StringType()), T.StructField("budget", T.DoubleType())])
    rows = [(u, i, START + timedelta(hours=h), f, k, c, b) for i, (u, h, f, k, c, b) in enumerate(turns)]
    for name, part in (("1", rows[:17]), ("2", rows[17:20]), ("3", rows[20:22]), ("4", rows[22:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    told = conversation.conversations(stream, "user", "n", "ts", "failed", "intent", ["colour"], "budget", late="48 hours")
    got = {r["user"]: (r["n_turns"], r["failures"], r["intent"], r["tastes"], r["budgets"]) for r in funnel.run_updates(told, str(tmp_path / "out"), ["user"]).collect()}
    assert got == fold(turns, 6)
    assert got["b"][0] == 2 and got["a"][0] == 16 and len(got["a"][4].split(";")) == 10
