"""Personal data by candidate gradient boosting. DataFrame and SQL functions only on the rows' path.

High-recall patterns propose spans, boosted trees score format and context, and a calibrated threshold selects. Spans
that meet the base definition of their kind always stay. The trees are fitted on candidates mined from a sample of the
documents, whose labels are the base definition and its checks, without what the definition itself asks for among the
features; and on examples from templates for forms that the documents don't have. MINED and EXAMPLES bound both.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_names
from .gbt import Forest, fit

KINDS = ("email", "ip", "card", "phone")
#: The base definition of each kind. Possessive runs and \G change no match: they keep long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms that the trees judge. A cheap test for each comes first.
LOOSE = {
    "email": (r"[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+ ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,12}+", r"\bat[)\]}]"),
    "ip": (r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}+(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    "card": (r"(?<![0-9.])[0-9]{4}[ .-][0-9]{4}[ .-][0-9]{4}[ .-][0-9]{4}(?![0-9.])", r"[0-9]{4}[ .-][0-9]{4}[ .-][0-9]{4}"),
    "phone": (r"(?<![0-9+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", r"[0-9][ .-][0-9]{4}(?![0-9-])"),
}
#: Wider forms, mined for training: the base forms and what only resembles them.
WIDE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9.-]{1,255}+",
    "ip": r"(?<![0-9.])[0-9]{1,9}+(?:\.[0-9]{1,9}+){2,5}+",
    "card": r"(?<![0-9.-])[0-9]{4}(?:[ -]?[0-9]{2,4}){2,5}+(?![0-9])",
    "phone": r"(?<![0-9.])\+?\(?[0-9]{1,4}+\)?(?:[ .-]?\(?[0-9]{2,4}+\)?){2,4}+",
}
CUES = r"(?i)(?:mail|write|contact|phone|tel|call|mobile|cell|fax|ring|whatsapp|card|visa|credit|pay|account|host|address|server|client|login|ssh)"
#: Code points before a span that are its context; template examples; documents mined and candidates kept of them; the precision for which the threshold is calibrated.
CONTEXT, EXAMPLES, MINED_DOCS, MINED, PRECISION = 24, 4000, 3000, 4000, 0.99
#: Hits of a text are handled in chunks of so many, so that arrays are never copied once a hit.
CHUNK = 128
FEATURES = ("kind", "n_chars", "n_digits", "n_seps", "valid", "cue", "glued", "letters", "numbered", "distinct")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _chunks(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.slice(F.array(items), 2, 1))


_HIT = "s:int,e:int,t:string,b:string,a:string"


def _hits(text: Column, pattern: str, when: Column) -> Column:
    """array<struct<s,e,t,b,a>>: the matches of ``pattern`` with their code points, end exclusive, and what stands before and after; empty unless ``when``.

    split() and regexp_extract_all() find the same matches, so gaps and matches alternate and their lengths add up: over
    chunks first, then within each.
    """
    none = F.array().cast(f"array<struct<{_HIT}>>")

    def parts(found: Column, gaps: Column) -> Column:
        n = F.size(found)
        zipped = F.arrays_zip(F.slice(gaps, F.lit(1), n).alias("g"), found.alias("t"), F.slice(gaps, F.lit(2), n).alias("a"))
        return F.transform(zipped, lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["t"]).alias("n"), x["t"].alias("t"), F.right(x["g"], F.lit(CONTEXT)).alias("b"), F.left(x["a"], F.lit(1)).alias("a")))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["g"]
        return F.struct((s + x["n"]).alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["t"].alias("t"), x["b"].alias("b"), x["a"].alias("a")))).alias("out"))

    def placed(chunks: Column) -> Column:
        lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["g"] + x["n"]))
        starts = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    all_ = _let(found, lambda f: _let(parts(f, F.split(text, pattern, -1)), lambda p: _let(_chunks(p), placed)))
    return F.when(when & (F.regexp_count(text, F.lit(pattern)) > 0), all_).otherwise(none)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(t: Column) -> Column:
    """Whether the digits of ``t`` pass Luhn: from the right every second one counts double, less 9 above 9."""
    digits = F.split(F.reverse(_digits(t)), "")
    total = F.aggregate(
        F.transform(digits, lambda d, i: F.when(i % 2 == 0, F.coalesce(d.try_cast("int"), F.lit(0))).otherwise(F.pmod(F.coalesce(d.try_cast("int"), F.lit(0)) * 2, F.lit(10)) + F.floor(F.coalesce(d.try_cast("int"), F.lit(0)) / 5).cast("int"))),
        F.lit(0),
        lambda a, d: a + d,
    )
    return total % 10 == 0


def _valid(kind: str, t: Column) -> Column:
    """What a base match must meet besides its pattern."""
    n = F.length(_digits(t))
    if kind == "ip":
        return F.forall(F.split(t, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & F.forall(F.split(t, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(t)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda x: _valid(kind, x["t"])


def _as(kind: int, name: str, *more: str):
    """A span with its kind's number."""
    return lambda x: F.struct(F.lit(kind).alias(name), x["s"].alias("s"), x["e"].alias("e"), *[x[m].alias(m) for m in more])


def base_spans(out: str) -> Column:
    """After ``find``: array<struct<k,s,e>> of the base spans, by kind as in KINDS, then start."""
    return F.array_sort(F.concat(*[F.transform(F.col(out)[k], _as(i, "k")) for i, k in enumerate(KINDS)]))


def candidates(text: Column) -> tuple[dict[str, Column], Column]:
    """Base spans of each kind, and all loose candidates as array<struct<kind,s,e,t,b,a>>."""
    digit = F.rlike(text, F.lit("[0-9]"))
    need = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": F.rlike(text, F.lit("[0-9][ -]?[0-9]")), "phone": F.contains(text, F.lit("+"))}
    base = {k: F.filter(_hits(text, BASE[k], need[k]), _checked(k)) for k in KINDS}
    loose = [F.transform(_hits(text, p, F.rlike(text, F.lit(test))), _as(i, "kind", "t", "b", "a")) for i, (p, test) in enumerate(LOOSE[k] for k in KINDS)]
    return base, F.concat(*loose)


def features(x: Column) -> Column:
    """A candidate's format and context as a struct of doubles. A leading plus, for which the base definition asks, isn't looked at."""
    t, before, after = F.ltrim(x["t"], F.lit("+")), x["b"], x["a"]
    digits = _digits(t)
    values = {
        "kind": x["kind"],
        "n_chars": F.length(t),
        "n_digits": F.length(digits),
        "n_seps": F.regexp_count(t, F.lit("[ .()-]")),
        "valid": F.when(x["kind"] == 2, _luhn(t).cast("int")).otherwise(F.lit(1)),
        "cue": F.rlike(before, F.lit(CUES)).cast("int"),
        "glued": (F.rlike(before, F.lit("[A-Za-z0-9_#=/$]$")) | F.rlike(after, F.lit("^[A-Za-z0-9_=/]"))).cast("int"),
        "letters": F.regexp_count(t, F.lit("[A-Za-z]")),
        "numbered": F.when(F.rlike(before, F.lit(r"(?i)(?:order|ref|no|id|version|page|isbn|part)[.:# ]{0,3}$")), F.lit(1)).otherwise(F.lit(0)),
        "distinct": F.size(F.array_distinct(F.split(digits, ""))),
    }
    return F.struct(*[values[f].cast("double").alias(f) for f in FEATURES])


def mined(docs: DataFrame, text: str = "text", most: int = MINED_DOCS) -> DataFrame:
    """(id, y, f): wide candidates of about ``most`` documents, spread by a hash; y is 1 for those that meet the base definition."""
    n = docs.count()
    some = docs.select(F.xxhash64(text).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.pmod(F.col("id"), F.lit(max(1, n // most))) == 0)
    hits = [F.transform(_hits(F.col("text"), WIDE[k], F.rlike("text", F.lit("[0-9@]"))), _as(i, "kind", "t", "b", "a")) for i, k in enumerate(KINDS)]
    rows = some.select("id", F.explode(F.concat(*hits)).alias("x"))
    good = reduce(lambda c, i: c.when(F.col("x.kind") == i, F.rlike("x.t", F.lit(f"^(?:{BASE[KINDS[i]]})$")) & _valid(KINDS[i], F.col("x.t"))), range(1, len(KINDS)), F.when(F.col("x.kind") == 0, F.rlike("x.t", F.lit(f"^(?:{BASE[KINDS[0]]})$"))))
    return rows.select("id", F.coalesce(good, F.lit(False)).cast("int").alias("y"), features(F.col("x")).alias("f"))


def _examples(spark: SparkSession, n: int) -> DataFrame:
    """(text, y): a candidate between two made-up contexts, from templates that hold personal data or only look so."""

    def pick(values: list[str], salt: int) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))

    def number(digits: int, salt: int) -> Column:
        return F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**digits)).cast("string"), digits, "0")

    hexa = [F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(str(k)))), 1, 4) for k in range(8)]
    name = F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 7), "0123456789", "ghijklmnop")
    like_phone = F.concat(pick(["(", ""], 1), number(3, 2))
    phone = F.when(F.startswith(like_phone, F.lit("(")), F.concat(like_phone, F.lit(") "), number(3, 3), F.lit("-"), number(4, 4))).otherwise(F.concat(like_phone, pick(["-", ".", " "], 5), number(3, 3), pick(["-", ".", " "], 5), number(4, 4)))
    card15 = [number(4, 6), number(4, 7), number(4, 8)]
    sep = pick(["-", " ", "."], 9)
    body = F.concat(*card15, number(3, 10))
    twice = F.aggregate(F.transform(F.split(body, ""), lambda d, i: F.when(i % 2 == 0, F.pmod(d.cast("int") * 2, F.lit(10)) + F.floor(d.cast("int") / 5).cast("int")).otherwise(d.cast("int"))), F.lit(0), lambda a, d: a + d)
    good = F.pmod(10 - F.pmod(twice, F.lit(10)), F.lit(10))
    card = F.concat(card15[0], sep, card15[1], sep, card15[2], sep, number(3, 10))
    email = F.concat(name, pick([" (at) ", "(at)", "[at]", " [at] "], 11), F.lit("mail"), pick([".", " (dot) ", "[dot]"], 12), pick(["com", "org", "net"], 13))
    warm = pick(["please call ", "tel. ", "phone: ", "reach us on mobile ", "my credit card is ", "pay with card ", "contact: ", "login from host ", "server address "], 14)
    plain = pick(["the value was ", "and then ", "sum of ", "", "in the "], 15)
    cold = pick(["order no. ", "ref ", "part id #", "version ", "isbn ", "page "], 16)
    ends = pick([".", " and so on", ", the rest", ""], 17)
    wrong = F.pmod(good + 1 + F.pmod(F.xxhash64("id", F.lit(18)), F.lit(8)), F.lit(10))
    cases = [
        (F.concat(warm, phone, ends), 1), (F.concat(cold, phone, ends), 0), (F.concat(plain, phone, ends), 0),
        (F.concat(warm, card, good.cast("string"), ends), 1), (F.concat(plain, card, good.cast("string"), ends), 1),
        (F.concat(plain, card, wrong.cast("string"), ends), 0), (F.concat(cold, card, wrong.cast("string"), ends), 0),
        (F.concat(warm, email, ends), 1), (F.concat(plain, email, ends), 1),
        (F.concat(warm, F.concat_ws(":", *hexa), ends), 1), (F.concat(plain, F.lit("k="), F.concat_ws(":", *hexa), ends), 0),
        (F.concat(plain, F.lit("x"), phone, F.lit("z")), 0),
    ]
    which = F.pmod(F.col("id"), F.lit(len(cases)))
    text = reduce(lambda c, k: c.when(which == k, cases[k][0]), range(1, len(cases)), F.when(which == 0, cases[0][0]))
    y = F.element_at(F.array(*[F.lit(c[1]) for c in cases]), (which + 1).cast("int"))
    return spark.range(0, n, numPartitions=2).select("id", text.alias("text"), y.alias("y"))


def train(docs: DataFrame, text: str = "text", n: int = EXAMPLES) -> tuple[Forest, float, dict[str, float]]:
    """The trees; the least margin at which, of the examples they weren't fitted on, PRECISION of the selected are personal;
    and, of held-out mined candidates, the precision and the share found at that margin.
    """
    made = _examples(docs.sparkSession, n).withColumn("_c", candidates(F.col("text"))[1])
    made = made.select("id", "y", F.explode("_c").alias("x")).select("id", "y", features(F.col("x")).alias("f")).withColumn("real", F.lit(False))
    real = mined(docs, text).orderBy(F.xxhash64("id", "f"), "id", "f").limit(MINED).withColumn("real", F.lit(True))
    rows = sorted(made.unionByName(real).collect(), key=lambda r: (r["real"], r["id"], tuple(r["f"]), r["y"]))
    x, y = np.array([list(r["f"]) for r in rows]), np.array([r["y"] for r in rows], dtype=float)
    held, real_ = np.array([r["id"] % 5 == 0 for r in rows]), np.array([r["real"] for r in rows])
    forest = fit(x[~held], y[~held], trees=24, depth=3, rate=0.3)
    margin, truth = forest.margin(x[held]), y[held]
    order = np.argsort(-margin, kind="stable")
    right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    m = margin[order]
    whole = np.r_[m[1:] < m[:-1], True]  # a margin is in with all its equals
    fine = np.flatnonzero((right >= PRECISION) & whole)
    least = float(m[fine[-1]]) if len(fine) else float("inf")
    chosen, true = (margin >= least) & real_[held], truth[real_[held]].sum()
    hits = truth[chosen].sum()
    return forest, least, {"candidates": int(real_.sum()), "held_out": int(real_[held].sum()), "precision": float(hits / max(1, chosen.sum())), "recall": float(hits / max(1, true))}


def find(docs: DataFrame, out: str, text: str = "text", model: tuple[Forest, float, dict] | None = None) -> DataFrame:
    """``docs`` and the struct ``out``: for each kind the base spans, array<struct<s,e,t,b,a>>, and in ``extra`` the trees', array<struct<kind,s,e>>.

    Extra spans overlap no base span. Null text counts as empty and has none. Repeated rows are judged alike; an empty
    table stays empty; columns keep their names. Everything happens within a row, so nothing is shuffled.
    """
    forest, least, _ = model or train(docs, text)
    body, spans, scored = fresh_names(docs, "body", "spans", "scored")
    held = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    base, loose = candidates(F.col(body))
    held = held.withColumn(spans, F.struct(*[base[k].alias(k) for k in KINDS], loose.alias("loose")))

    def boxes(items: Column) -> Column:
        return F.transform(_chunks(items), lambda c: F.struct(c[0]["s"].alias("lo"), F.element_at(c, -1)["e"].alias("hi"), c.alias("c")))

    def free(taken: Column) -> Column:
        def meets(x: Column):
            return lambda box: (box["lo"] < x["e"]) & (box["hi"] > x["s"]) & F.exists(box["c"], lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))

        return F.transform(F.filter(F.col(f"{spans}.loose"), lambda x: ~F.exists(taken, meets(x))), lambda x: F.struct(x.alias("x"), features(x).alias("f")))

    some = F.size(F.col(f"{spans}.loose")) > 0
    held = held.withColumn(scored, F.when(some, _let(F.concat(*[boxes(F.col(spans)[k]) for k in KINDS]), free)))
    chosen = F.expr(f"transform(filter({scored}, c -> {forest.sql([f'c.f.{f}' for f in FEATURES])} >= {least!r}D), c -> struct(c.x.kind as kind, c.x.s as s, c.x.e as e))") if np.isfinite(least) else F.lit(None)
    extra = F.coalesce(chosen, F.array().cast("array<struct<kind:int,s:int,e:int>>"))
    return held.select(*docs.columns, F.struct(*[F.col(spans)[k].alias(k) for k in KINDS], extra.alias("extra")).alias(out))


def all_spans(out: str) -> Column:
    """After ``find``: array<struct<k,s,e>> of base and extra spans, by kind as in KINDS, then start."""
    extra = F.transform(F.col(out)["extra"], lambda x: F.struct(x["kind"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    return F.array_sort(F.concat(base_spans(out), extra))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", model: tuple[Forest, float, dict] | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans become one, named by the first.

    Null and empty texts stay as they are; all columns keep their names and places. Spans are replaced in chunks, so that
    a text with very many of them isn't copied once for each.
    """
    found_, list_ = fresh_names(docs, "found", "list")
    found = find(docs, found_, text, model)
    spans = F.array_sort(F.transform(all_spans(found_), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    body = F.col(text)

    def chunk(a: Column, c: Column) -> Column:
        end = F.greatest(a["at"], F.array_max(F.transform(c, lambda x: x["e"])))
        part = F.substring(body, a["at"] + 1, end - a["at"])

        def replaced(part: Column) -> Column:
            def step(b: Column, x: Column) -> Column:
                gap = F.substring(part, b["at"] - a["at"] + 1, F.greatest(x["s"] - b["at"], F.lit(0)))
                text_ = F.when(x["s"] < b["at"], b["out"]).otherwise(F.concat(b["out"], gap, F.element_at(names, x["k"] + 1)))
                return F.struct(F.greatest(b["at"], x["e"]).alias("at"), text_.alias("out"))

            return F.aggregate(c, F.struct(a["at"].alias("at"), F.lit("").alias("out")), step, lambda b: b["out"])

        return F.struct(end.alias("at"), F.concat(a["out"], F.array(_let(part, replaced))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(_chunks(F.col(list_)), start, chunk, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(body, a["at"] + 1, F.length(body))))
    found = found.withColumn(list_, spans)
    return found.withColumn(text, F.when(F.size(list_) > 0, clean).otherwise(body)).select(*docs.columns)
