"""Personal data: four base kinds by pattern, and identifiers that their contexts give away. DataFrame functions only.

Base kinds are found leftmost and without overlap; matches that fail their test (IP parts, Luhn, number of digits) are dropped.
The patterns are written so that the regular-expression engine never goes back over a run of characters.

Bootstrapping. Base spans are the seeds. A lexical pattern is the word before an instance, or that word with the word after it.
Words that look like identifiers (MIN_LENGTH characters; MIN_DIGITS digits or an @; numbers with blanks, brackets, dots and plus
signs in one) and overlap no base span are the open instances. In the graph of patterns and instances a pattern's trust is the
mean of its instances' scores, drawn towards zero by one more instance, and counts if at least MIN_SEEDS different seeds share
the pattern. An open instance's score is the mean of its patterns' trust, times OTHER_CLASS where no seed of the pattern has its
class (mail, address, number, mixed). Instances whose score reaches MIN_SCORE are seeds of the next of ROUNDS rounds. In the end
open instances whose pattern's trust, so weighted, reaches MIN_SCORE become spans of kind ``context``. The graph holds one row
for each pattern and instance, so a pattern met often costs no more than a rare one.

Defined cases: null and empty text have no spans; equal rows have equal spans; ties are ordered by start, kind, end; an empty
table gives an empty result; only ``doc_id`` and ``text`` are read for spans, and ``redact`` keeps all columns of its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.scratch import stored
from ledgerspark.session import fewer

KINDS = ("email", "ip", "card", "phone", "context")
ROUNDS = 3
MIN_SEEDS = 3
MIN_SCORE = 0.6
MIN_LENGTH = 8
MIN_DIGITS = 6
OTHER_CLASS = 0.7

# The base kinds as they are asked for.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Stands for a blank or hyphen between two digits while cards are looked for; a text's own character of this kind is changed first.
_JOIN, _NOT_JOIN = "\ue000", "\ue001"
CARD = f"[0-9][0-9{_JOIN}]+"
_HEX = r"[0-9A-Fa-f]{1,4}+(?::{1,2}+[0-9A-Fa-f]{1,4}+){3,7}+"
_NUMBER = r"\+?+\(?+[0-9]++(?:(?!\x20[0-9](?![0-9]))(?:\)?+[\x20-]?+\(?+|\.)[0-9]++)*+(?![A-Za-z0-9_@-])"
_MIXED = r"(?=[A-Za-z_.+%-]*+[0-9@])[A-Za-z0-9_]++(?:[.@+%-]++[A-Za-z0-9_]++)*+"
OPEN = rf"(?<![A-Za-z0-9_])(?:{_HEX}|{_NUMBER}|{_MIXED})"

_SPAN = "array<struct<start:int,stop:int,text:string>>"


def _spans(text: Column, pieces: Column, matches: Column) -> Column:
    """Places of the matches, from the lengths of what lies between them."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["before"]
        stop = start + F.length(x["match"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["match"].alias("text")))).alias("out"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("before"), m.alias("match")))
    return F.aggregate(pairs, empty, step, lambda acc: acc["out"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's test; every second digit from the right counts twice, less nine if over nine."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), n)

    def worth(k: Column) -> Column:
        d = F.substring(digits, k, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - k) % 2 == 1, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), lambda acc, k: acc + worth(k)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return match.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _kept(kind: str) -> Column:
    valid = F.filter(F.col(f"_s_{kind}"), lambda s: _valid(kind, s["text"]))
    return F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["stop"].alias("stop")))


def _number(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")


def _found(rows: DataFrame) -> DataFrame:
    """Add ``base``, the valid spans of the base kinds, and ``open``, words that look like identifiers."""
    text = F.col("_text")
    searched = {
        "email": (text, EMAIL, text.contains("@")),
        "ip": (text, IP, text.rlike(r"[0-9]\.[0-9]")),
        "card": (F.col("_joined"), CARD, text.rlike("[0-9]")),
        "phone": (text, PHONE, text.contains("+")),
        "open": (text, OPEN, text.rlike("[0-9@]")),
    }
    rows = rows.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    joined = F.regexp_replace(F.translate(text, _JOIN, _NOT_JOIN), r"(?<=[0-9])[\x20-](?=[0-9])", _JOIN)
    rows = rows.withColumn("_joined", F.when(text.rlike("[0-9]"), joined).otherwise(""))
    rows = rows.withColumns({f"_m_{k}": F.when(test, F.regexp_extract_all(where, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for k, (where, p, test) in searched.items()})
    rows = rows.withColumns(
        {f"_s_{k}": F.when(F.size(f"_m_{k}") > 0, _spans(where, F.split(where, p, -1), F.col(f"_m_{k}"))).otherwise(F.array().cast(_SPAN)) for k, (where, p, _) in searched.items()}
    )
    rows = rows.withColumn("base", F.array_sort(F.concat(*(_kept(k) for k in KINDS[:4]))))

    def context(s: Column) -> Column:
        before = F.substring(text, F.greatest(F.lit(1), s["start"] - 79), F.least(F.lit(80), s["start"]))
        word = F.lower(F.regexp_extract(F.rtrim(F.translate(before, "\t\n\x0b\x0c\r", "     ")), r"[^\x20]*+$", 0))
        match = F.substring(text, s["start"] + 1, s["stop"] - s["start"])
        behind = F.ltrim(F.translate(F.substring(text, s["stop"] + 1, F.lit(80)), "\t\n\x0b\x0c\r", "     "))
        after = F.lower(F.regexp_extract(behind, r"^[^\x20]*+", 0))
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), word.alias("word"), after.alias("after"), match.alias("match"))

    digits = F.filter(F.col("_s_open"), lambda s: (F.length(s["text"]) >= MIN_LENGTH) & ((F.length(_digits(s["text"])) >= MIN_DIGITS) | s["text"].contains("@")))
    free = F.filter(digits, lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return rows.withColumns({"seeds": F.transform("base", context), "open": F.transform(free, context)})


def _class(match: Column) -> Column:
    mail, address, number = match.contains("@"), match.rlike(r"^[0-9A-Fa-f]++(?:[.:]++[0-9A-Fa-f]++){3,}+$"), match.rlike(r"^[0-9\x20+().-]++$")
    return F.when(mail, "mail").when(address, "address").when(number, "number").otherwise("mixed")


def _patterns(x: str) -> Column:
    """The word before, and with the word after it; words hold no blank."""
    word, after = F.col(f"{x}.word"), F.col(f"{x}.after")
    return F.filter(F.array(word, F.when(after != "", F.concat_ws(" ", word, after))), lambda p: p.isNotNull() & (p != ""))


def _weighted() -> Column:
    return F.col("trust") * F.when(F.array_contains("classes", F.col("class")), 1.0).otherwise(OTHER_CLASS)


def trusted_patterns(found: DataFrame) -> DataFrame:
    """``pattern, trust, classes`` of the patterns that the graph of ``found(seeds, open)`` makes trustworthy."""
    sides = [found.select(F.explode(c).alias("x"), F.lit(c == "seeds").alias("seed")) for c in ("seeds", "open")]
    edges = sides[0].union(sides[1]).select(F.explode(_patterns("x")).alias("pattern"), F.col("x.match").alias("instance"), "seed")
    edges = edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")).withColumn("class", _class(F.col("instance")))
    edges = stored(fewer(edges, found.count()), "edges")
    n = edges.count()

    def scored(known: DataFrame) -> DataFrame:
        seeds = F.count_if("seed")
        trust = known.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("trust"), F.collect_set(F.when(F.col("seed"), F.col("class"))).alias("classes"), seeds.alias("seeds"))
        return trust.filter(F.col("seeds") >= MIN_SEEDS).drop("seeds")

    known = edges.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(0.0))
    for _ in range(ROUNDS):
        able = stored(fewer(scored(known), n), "able")
        by_instance = edges.filter(~F.col("seed")).join(able, "pattern").groupBy("instance").agg(F.avg(_weighted()).alias("reached"))
        known = edges.join(by_instance, "instance", "left")
        score = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("reached", F.lit(0.0)))
        known = known.withColumn("score", score).withColumn("seed", F.col("seed") | (F.col("score") >= MIN_SCORE)).drop("reached")
        known = stored(fewer(known, n), "scored")
    return scored(known).filter(F.col("trust") >= MIN_SCORE)


def _discovered(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """``_row, more``: spans of open instances in trusted patterns."""
    rows = found.filter(F.size("open") > 0).select("_row", F.explode("open").alias("x"))
    rows = rows.select("_row", "x.start", "x.stop", _class(F.col("x.match")).alias("class"), F.explode(_patterns("x")).alias("pattern"))
    rows = rows.join(patterns, "pattern").filter(_weighted() >= MIN_SCORE)
    span = F.struct(F.col("start"), F.lit(KINDS.index("context")).alias("kind"), F.col("stop"))
    return rows.groupBy("_row").agg(F.collect_set(span).alias("more"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))))


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id``, numbers of base spans by kind, digest of the base spans and all spans as text, for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("_row", F.monotonically_increasing_id())
    found = stored(_found(rows).select("_row", "doc_id", "base", "seeds", "open"), "found")
    more = _discovered(found, trusted_patterns(found))
    rows = found.select("_row", "doc_id", "base").join(more, "_row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,stop:int>>"))))
    return rows.select("doc_id", *map(_number, KINDS[:4]), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(every).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; overlapping spans go as the first of them."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*(docs[c] for c in docs.columns)).alias("_rest"), F.col("text").cast("string"))
    rows = stored(_found(rows).select("_row", "_rest", "base", "seeds", "open"), "texts").withColumn("text", F.col("_rest.text").cast("string"))
    more = _discovered(rows, trusted_patterns(rows))
    # only rows with open instances can have further spans: the others do not travel
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    still = rows.filter(F.size("open") == 0).withColumn("more", none)
    rows = still.unionByName(fewer(rows.filter(F.size("open") > 0).join(more, "_row", "left"), rows.count())).drop("seeds", "open")
    every = F.array_sort(F.concat("base", F.coalesce("more", none)))
    names = F.array(*map(F.lit, KINDS))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))))
        marked = F.concat(piece, F.lit("<"), F.get(names, s["kind"]), F.lit(">"))
        after = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(after, marked).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("_all", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    rows = rows.withColumn("_all", every).withColumn("text", F.when(F.size("_all") > 0, done).otherwise(F.col("text")))
    return rows.select(F.col("_rest").withField("text", F.col("text")).alias("_rest")).select("_rest.*")
