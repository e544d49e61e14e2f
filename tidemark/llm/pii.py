"""Personal data by patterns, and by contexts that are bootstrapped from them.

Base matches (email, ip, card, phone) are seeds. The words around a seed are lexical
patterns; other identifier-like tokens (those with a digit), with neighbouring ones
that only blanks and signs part from them, are unknown instances where they stand in
the same patterns. Scores run over the graph of patterns and
instances: a pattern is as sure of a kind as the share of its places that hold
instances of that kind, an instance as sure as its patterns together. Places of
unknown instances in patterns that are sure enough become spans.

Only DataFrame functions are used. Regular expressions possess what they match, so
texts of any length are read in linear time.
"""

from pyspark.sql import Window, functions as F

from .common import col, free_names, store, texts

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SURE = 0.8
SUPPORT = 3
CONTEXT = 64

# The fixed base patterns, written so that a run of letters or digits is tried once.
_MAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TOKEN = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
_DIGIT = "[0-9]"
# What may stand between tokens of one instance: after the one, between them, and before the other.
_TAIL, _GAP, _LEAD = r"^[)\]/-]*$", r"^[\x20\t]+(?:[()/+.-]+[\x20\t]+)*$", r"^[(\[/+-]*$"

_MATCH = "array<struct<kind:int,i:int,gap:bigint,value:string,before:string,after:string>>"


def _matches(kind, text, pattern, guard):
    """Matches with the length of the gap before each, and the words next to it."""
    gaps = F.split(text, pattern, -1)
    # Zipped, so that the text is cut once a row and not once a match. Start and length of the slice stay far below
    # the largest int: without generated code their sum would overflow and the slice be empty.
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), gaps, F.slice(gaps, 2, F.size(gaps)))
    found = F.transform(
        zipped,
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"), i.cast("int").alias("i"), F.length(z["1"]).cast("bigint").alias("gap"),
            z["0"].alias("value"), F.right(z["1"], F.lit(CONTEXT)).alias("before"), F.left(z["2"], F.lit(CONTEXT)).alias("after"),
        ),
    )
    # There is a gap more than there are matches.
    return F.when(guard, F.filter(found, lambda m: m["value"].isNotNull())).otherwise(F.array()).cast(_MATCH)


def _luhn(digits):
    digit = lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
    each = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.when(i % 2 == 1, digit(i)).otherwise((2 * digit(i) / 10).cast("int") + 2 * digit(i) % 10),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid():
    value, kind = F.col("value"), F.col("kind")
    digits = F.regexp_replace("value", "[^0-9]", "")
    short = F.transform(F.split("value", r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    small = F.forall(short, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    n = F.length(digits)
    return (
        F.when(kind == 0, True).when(kind == 1, small)
        .when(kind == 2, F.when(n.between(12, 19), _luhn(digits)).otherwise(False))
        .when(kind == 3, n.between(9, 15)).otherwise(value != "")
    )


def _context(row):
    """The last word before (with a mark that follows it) and the first word after, digits made alike."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    return row.withColumn(
        "left", plain(F.regexp_extract("before", r"(\S+(?:\s+[^\p{L}\p{N}\s]+)?)\s*[\"'(\[<]*$", 1))
    ).withColumn("right", plain(F.regexp_extract("after", r"^[\"')\]>.,;:!?]*\s*(\S+)", 1)))


def _located(raw):
    """A row for each match: kind, start, end, value and context; a run of tokens' bare cores as kind 4."""
    per = Window.partitionBy("row", "kind").orderBy("i")
    at = (
        raw.select("row", F.explode("found").alias("m")).select("row", "m.*")
        .withColumn("start", F.sum("gap").over(per) + F.sum(F.length("value")).over(per) - F.length("value"))
    )
    base = at.where("kind < 4").where(_valid())
    # name=value is the context name= and the core value.
    token = at.where("kind = 4").withColumn("lead", F.regexp_extract("value", r"(?s)^((?:.*[=:])?[^\p{L}\p{N}]*)[\p{L}\p{N}]*[0-9]", 1))
    lead = F.length("lead")
    token = (
        token.withColumn("core", F.regexp_extract(F.substring("value", lead + 1, F.length("value") - lead), r"(?s)^(.*[\p{L}\p{N}])", 1))
        .withColumn("tail", F.substring("value", lead + F.length("core") + 1, F.length("value")))
        .withColumn("start", F.col("start") + lead).withColumn("value", F.col("core")).drop("core")
    )
    both = base.unionByName(token.where(_valid()), allowMissingColumns=True)
    both = both.withColumn("end", F.col("start") + F.length("value"))
    seed = F.col("kind") < 4
    per = Window.partitionBy("row")
    so_far = lambda *by: per.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(seed, F.col("end"))).over(so_far("start", "kind"))
    ahead = F.min(F.when(seed, F.col("start"))).over(so_far(F.desc("start"), F.desc("kind")))
    apart = F.coalesce(reach <= F.col("start"), F.lit(True)) & F.coalesce(ahead >= F.col("end"), F.lit(True))
    both = both.withColumn("apart", apart)
    columns = ["row", "kind", "start", "end", "value", "before", "after"]
    runs = _runs(both.where("kind = 4"))
    return _context(both.where(seed).select(*columns).unionByName(runs.select(*columns))).select(
        "row", "kind", "start", "end", F.lower("value").alias("value"), "left", "right")


def _runs(token):
    """Neighbouring tokens joined by blanks and signs as one instance; tokens that meet a seed end a run and go."""
    per = Window.partitionBy("row").orderBy("i")
    named = F.col("lead").rlike("[=:]")
    last = lambda c: F.lag(c).over(per)
    joined = (
        F.col("apart") & last("apart") & (last("i") == F.col("i") - 1) & (F.col("gap") <= CONTEXT)
        & last("tail").rlike(_TAIL) & F.col("before").rlike(_GAP) & F.col("lead").rlike(_LEAD)
    )
    token = token.withColumn("joined", F.coalesce(joined, F.lit(False)))
    token = token.withColumn("piece", F.when(F.col("joined"), F.concat(last("tail"), "before", "lead", "value")).otherwise(F.col("value")))
    token = token.withColumn("run", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(per.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda p: p["piece"])
    run = token.where("apart").groupBy("row", "run").agg(
        F.lit(4).alias("kind"), F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(pieces, "").alias("value"),
        F.min_by("lead", "i").alias("lead"), F.min_by("before", "i").alias("before"), F.max_by("after", "i").alias("after"))
    # A bracket that is closed inside belongs to the instance.
    opened = F.col("lead").rlike(r"\($") & F.col("value").rlike(r"^[^()]*\)")
    return (
        run.withColumn("before", F.when(named, F.col("lead")).otherwise(F.col("before")))
        .withColumn("start", F.when(opened, F.col("start") - 1).otherwise(F.col("start")))
        .withColumn("value", F.when(opened, F.concat(F.lit("("), "value")).otherwise(F.col("value")))
    )


def _places(located):
    """Every place with each of its patterns."""
    word = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), c))
    both = F.when((F.col("left") != "") & (F.col("right") != ""), F.concat(F.lit("B:"), "left", F.lit(" _ "), "right"))
    marks = F.array_compact(F.array(word("L:", F.col("left")), word("R:", F.col("right")), both))
    return located.select("row", "kind", "start", "end", "value", F.explode(marks).alias("pattern"))


def sure_patterns(located, rounds=ROUNDS, sure=SURE, support=SUPPORT):
    """Patterns with the kind they are sure of, after ``rounds`` rounds over the graph."""
    edges = store(_places(located).groupBy("pattern", "value").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("kind") < 4, F.col("kind"))).alias("seed")), "edges")
    seeds = edges.where("seed IS NOT NULL").groupBy("value").agg(F.max("seed").alias("kind")).withColumn("trust", F.lit(1.0))
    unknown = edges.join(seeds.select("value"), "value", "left_anti")
    size = edges.groupBy("pattern").agg(F.sum("n").alias("places"))
    trusted, patterns = seeds, None
    for _ in range(rounds):
        held = edges.join(trusted, "value").groupBy("pattern", "kind").agg(
            F.sum(F.col("n") * F.col("trust")).alias("mass"), F.sum("trust").alias("backing"))
        scored = held.where(F.col("backing") >= support).join(size, "pattern").select(
            "pattern", "kind", (F.col("mass") / (F.col("places") + 1)).alias("score"))
        patterns = store(scored.where("score >= 0.5"), "patterns")
        grown = unknown.join(patterns, "pattern").groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("trust"))
        trusted = seeds.unionByName(grown)
    return patterns.where(F.col("score") >= sure)


def find(docs, id_col="doc_id", text_col="text", rounds=ROUNDS, sure=SURE, support=SUPPORT):
    """Spans of every row: ``spans`` of (start, kind number, end, base), by start and kind.

    Starts and ends count code points, the end is exclusive. Null and empty texts
    have no spans; repeated rows are searched one by one and all count as
    evidence; ids may be null. A context reaches 64 code points and ends at the
    neighbouring match of its kind. Base spans of different kinds may overlap;
    discovered ones overlap no base span and never remove one.
    """
    rows = texts(docs, id_col, text_col)
    text, digit = F.col("text"), F.col("text").rlike(_DIGIT)
    found = F.concat(
        _matches(0, text, _MAIL, text.contains("@")), _matches(1, text, _IP, digit & text.contains(".")),
        _matches(2, text, _CARD, digit), _matches(3, text, _PHONE, digit & text.contains("+")),
        _matches(4, text, _TOKEN, digit),
    )
    # The row number is fixed by this table; text is read once and not moved.
    raw = store(rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("text_key"), found.alias("found")), "matches")
    located = store(_located(raw), "located")
    patterns = sure_patterns(located, rounds, sure, support)
    best = F.max_by("kind", F.struct("score", F.negative("kind")))
    unseen = _places(located.where("kind = 4")).drop("kind").join(patterns, "pattern").groupBy("row", "start", "end").agg(best.alias("kind"))
    span = lambda base: F.struct(F.col("start"), F.col("kind"), F.col("end"), F.lit(base).alias("base")).alias("span")
    spans = located.where("kind < 4").select("row", span(True)).unionByName(unseen.select("row", span(False)))
    each = spans.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,base:boolean>>")
    return raw.select("row", "doc_id", "text_key").join(each, "row", "left").select(
        "doc_id", "text_key", F.coalesce("spans", none).alias("spans"))


def _listed(spans):
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found):
    """Counts of the base kinds, a digest of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )


def _islands(spans):
    """Spans of one document joined where they overlap, under the first one's kind."""
    def add(done, s):
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        own = F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
        return F.when(last["end"] > s["start"], F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(
            F.concat(done, F.array(own)))

    return F.aggregate(spans, F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"), add)


def mask(docs, id_col="doc_id", text_col="text", **options):
    """All rows and columns as they are, with [EMAIL], [IP], [CARD] or [PHONE] for each span of the text."""
    found = find(docs, id_col, text_col, **options).where(F.size("spans") > 0)
    own, owner, owner_key, marked = free_names(docs, "own_key", "pii_id", "pii_key", "pii_spans")
    # Equal rows have equal spans, but for their order in the table.
    marks = found.groupBy(F.col("doc_id").alias(owner), F.col("text_key").alias(owner_key)).agg(F.max("spans").alias(marked))
    marks = marks.withColumn(marked, _islands(F.col(marked)))
    key = F.sha2(F.coalesce(col(text_col).cast("string"), F.lit("")), 256)
    joined = docs.withColumn(own, key).join(
        marks, F.col(owner).eqNullSafe(col(id_col).cast("long")) & (F.col(owner_key) == F.col(own)), "left")
    text, spans = col(text_col), F.col(marked)
    label = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"]).cast("int")
    pieces = F.transform(spans, lambda s, i: F.concat(
        F.substring(text, before(i) + 1, s["start"].cast("int") - before(i)), F.get(label, s["kind"])))
    end = F.get(spans, F.size(spans) - 1)["end"].cast("int")
    masked = F.concat(F.array_join(pieces, ""), F.substring(text, end + 1, F.length(text)))
    return joined.withColumn(text_col, F.when(spans.isNotNull(), masked).otherwise(text)).select(*map(col, docs.columns))
