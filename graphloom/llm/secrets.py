"""Secret scans in DataFrame operations alone: base patterns and character Markov models.

Base patterns find assignments, access keys and hex runs. On top of them, two first-order Markov models over
characters, one of random strings and one of ordinary identifiers, judge every other token of TOKEN_MIN or more
characters with a letter: a mean log-likelihood ratio above the margin makes it a span of kind `random`. Both
models are trained from labelled samples (token, label).

Positions are code points. Texts without a hit, nearly all, leave after one regular-expression test a kind; the
models are literals of len(ALPHABET)**2 numbers. Work grows with the text and, for n spans, as n ** 1.5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import unit_hash

#: The three base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Kinds in listed order with their pattern and least length (of the value for assignments, else the match).
KINDS = (("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24))

#: Least length of the tokens that the models judge.
TOKEN_MIN = 16
TOKEN = rf"[A-Za-z0-9+/_=-]{{{TOKEN_MIN},}}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Common words of program identifiers, for the model of ordinary names.
NAME_WORDS = (
    "account action active address after all amount array async back base batch before block body bool bottom box buffer build button bytes cache call category cell center change channel check child "
    "class clear click client close code color column command comment commit common compare complete config connect console contact container content context control cookie copy core count counter country create current cursor "
    "data database date debug default define delete delta depth desc device dialog digest directory disable display distance document domain double download draw driver duration edge edit element email empty enable encode end "
    "engine entity entry error event example execute exit export extract factory failed feature fetch field file filter final find first flag float flow folder font footer force format found frame from front full function "
    "get global graph grid group handle handler hash header height hidden history host hour html icon image import index info init inner input insert instance integer interface internal invalid invoice item iterator job join json "
    "key label language last layer layout left length level library light limit line link list load local lock log login long loop machine main manager map margin mask match matrix max member memory merge message meta method "
    "middle min minute mobile mode model module month mouse move name native network next node normal note notify null number object offset old open option order origin other outer output owner package page panel parent parse part "
    "partition password path pattern payload people period phone picture pixel place play plugin point policy pool port position post prefix previous price primary print priority private process product profile progress project property protocol "
    "provider public push query queue quick random range rate read ready real record redirect reference refresh region register release remote remove render replace report request require reset resource response result return right role root "
    "route row rule run sample save scale schedule schema scope score screen script scroll search second section secure select send sequence server service session setting setup shape share shift shop show size sort source space "
    "stack stage start state status step stop storage store stream string style submit success summary support switch symbol sync system table target task temp template test text theme thread time timeout title toggle token top total trace track "
    "transform tree trigger type under unique unit update upload user util valid value variable vector version video view visible warning week weight width window with word work worker wrapper write year zone"
).split()
#: Mean log-likelihood ratio a character above which a token counts as random.
MARGIN = 1.0
#: Rows of the labelled samples that training reads.
SAMPLE_DOCS, SAMPLE_SECRETS = 400, 2000


_NONE = "array<struct<start:int,end:int,kind:string,match:string>>"


def _let(value: Column, body) -> Column:
    """`body` of a value that is made once: a one-element array binds it to a name."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cut(text: Column, pattern: str) -> Column:
    """struct(between, matches): all matches, leftmost and not overlapping, and the texts around them."""
    return F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))


def _pieces(text: Column, pattern: str, kind: str) -> Column:
    """array<struct(start, end, kind, match)> of all matches, leftmost and not overlapping.

    A start is the running sum of the lengths before it. Sums run within blocks of about sqrt(n) matches and over
    the blocks, since each step of a running sum copies what it has so far.
    """

    def sized(x: Column) -> Column:
        gaps = F.slice(x["between"], 1, F.size(x["matches"]))
        return F.zip_with(gaps, x["matches"], lambda b, m: F.struct(F.char_length(b).alias("gap"), F.char_length(m).alias("size"), m.alias("match")))

    def spans(x: Column) -> Column:
        n = F.size(x)
        step = F.ceil(F.sqrt(n)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / step).cast("int") - 1), lambda k: F.slice(x, k * step + 1, step))
        return F.when(n > 0, _let(blocks, placed)).otherwise(F.array().cast(_NONE))

    def placed(blocks: Column) -> Column:
        total = lambda block: F.aggregate(block, F.lit(0), lambda acc, y: acc + y["gap"] + y["size"])
        before = F.aggregate(
            F.transform(blocks, total),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
            lambda acc, t: F.struct((acc["at"] + t).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
        )
        return _let(before["all"], lambda offsets: F.flatten(F.transform(blocks, lambda block, k: inside(block, F.get(offsets, k)))))

    def inside(block: Column, offset: Column) -> Column:
        def add(acc: Column, y: Column) -> Column:
            start = acc["at"] + y["gap"]
            span = F.struct(start.alias("start"), (start + y["size"]).alias("end"), F.lit(kind).alias("kind"), y["match"].alias("match"))
            return F.struct((start + y["size"]).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        return F.aggregate(block, F.struct(offset.alias("at"), F.array().cast(_NONE).alias("spans")), add)["spans"]

    return _let(_let(_cut(text, pattern), sized), spans)


#: For each kind, a pattern of matches that are long enough, and a test that costs next to nothing.
_LONG = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
_CHEAP = {"assign": lambda text: text.contains("=") | text.contains(":"), "access": lambda text: text.contains("AKIA"), "hex": lambda text: F.lit(True)}


def _counts(match: Column, kind: str) -> Column:
    return F.char_length(F.regexp_extract(match, ASSIGN, 2)) >= 6 if kind == "assign" else F.lit(True)


def spans_of(text: Column, kind: str) -> Column:
    """Spans of one base pattern in ascending order."""
    found = F.filter(_pieces(text, _LONG[kind], kind), lambda s: _counts(s["match"], kind))
    return F.when(_CHEAP[kind](text) & text.rlike(_LONG[kind]), found).otherwise(F.array().cast(_NONE))


def base_spans(text: Column) -> Column:
    """Spans of the base patterns, in the order of kinds."""
    return F.concat(*(spans_of(text, kind) for kind, _, _ in KINDS))


def _meets(spans: Column, m: Column) -> Column:
    """Whether one of the spans, ascending and apart, overlaps the span m: the last that starts before m ends."""

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        right = F.get(spans, mid)["start"] < m["end"]
        lower = F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(right, acc["hi"]).otherwise(mid).alias("hi"))
        return F.when(acc["lo"] < acc["hi"], lower).otherwise(acc)

    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(spans))))
    before = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve, lambda acc: acc["lo"])
    last = _let(before, lambda n: F.when(n > 0, F.get(spans, n - 1)["end"] > m["start"]))
    return F.coalesce(F.when(F.size(spans) > 0, last), F.lit(False))


def _pairs(token: Column) -> Column:
    """Adjacent character pairs of a token."""
    return _let(F.split(token, ""), lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.concat(a, b)))


def train(samples: DataFrame) -> dict[str, float]:
    """Log-likelihood ratio of each character pair from (token, label): 1 random, 0 ordinary.

    Counts are added one (Laplace) over the alphabet; pairs outside it are not learnt. The result has
    len(ALPHABET)**2 entries at most. Null tokens, tokens of one character and other labels are left out.
    """
    known = samples.where("label in (0, 1) and length(token) > 1").select("label", F.explode(_pairs(F.col("token"))).alias("pair"))
    alphabet = "[" + ALPHABET.replace("-", r"\-") + "]{2}"
    counts = known.where(F.col("pair").rlike("^" + alphabet + "$")).groupBy("label", "pair").agg(F.count("*").alias("n"))
    seen = {(r["label"], r["pair"]): r["n"] for r in counts.collect()}
    first = {}
    for (label, pair), n in seen.items():
        first[label, pair[0]] = first.get((label, pair[0]), 0) + n
    size = len(ALPHABET)

    def log_p(label: int, pair: str) -> float:
        return math.log((seen.get((label, pair), 0) + 1) / (first.get((label, pair[0]), 0) + size))

    return {pair: log_p(1, pair) - log_p(0, pair) for pair in (a + b for a in ALPHABET for b in ALPHABET)}


def random_samples(spark, n: int = SAMPLE_SECRETS) -> DataFrame:
    """(token, label 1): hex digests and base64 strings of hashed numbers, half each."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    token = F.when(F.col("id") % 2 == 0, F.substring(digest, 1, 40)).otherwise(F.substring(base64, 1, 40))
    return spark.range(n).select(token.alias("token"), F.lit(1).alias("label"))


def identifier_samples(docs: DataFrame, n: int = SAMPLE_DOCS) -> DataFrame:
    """(token, label 0): words of about `n` documents, chosen by hash of the id, and their joins as identifiers.

    What a base pattern marks is cut out first. Neighbours joined by `_`, as camel case and with a short
    number behind teach the model how ordinary names look.
    """
    total = docs.select("doc_id").count()
    few = docs.where("text is not null").where(unit_hash("doc_id", seed=10) < n / max(total, 1)).select(mask_base(F.col("text"), " ").alias("text"))
    few = few.repartition(docs.sparkSession.sparkContext.defaultParallelism)  # a few hundred texts, dealt to all cores
    few = few.select(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{3,}"), F.lit(0)).alias("words"))
    rest = lambda k: F.slice("words", k, F.size("words"))
    each = few.where(F.size("words") > 2).select(F.explode(F.arrays_zip(F.col("words").alias("w"), rest(2).alias("x"), rest(3).alias("y"))).alias("p"))
    each = each.select("p.*").where("w is not null and x is not null and y is not null")
    named = F.array(
        F.col("w"),
        F.concat_ws("_", F.lower("w"), F.lower("x"), F.lower("y")),
        F.concat(F.lower("w"), F.initcap("x"), F.initcap("y")),
        F.concat_ws("_", F.upper("w"), F.upper("x"), F.pmod(F.xxhash64("w"), F.lit(100)).cast("string")),
        F.concat_ws("-", F.lower("w"), F.lower("x"), F.lower("y")),
        F.concat_ws("/", F.lower("w"), F.lower("x"), F.lower("y")),
    )
    found = each.select(F.explode(named).alias("token"), F.lit(0).alias("label"))
    return found.union(name_samples(docs.sparkSession))


def name_samples(spark, n: int = 20_000) -> DataFrame:
    """(token, label 0): identifiers of three hashed NAME_WORDS, in snake, camel, kebab, upper and path form."""
    words = F.split(F.lit(" ".join(NAME_WORDS)), " ")
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(NAME_WORDS))) + 1).cast("int"))
    x = spark.range(n).select("id", pick(1).alias("a"), pick(2).alias("b"), pick(3).alias("c"), F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(100)).cast("string").alias("d"))
    forms = (F.concat_ws("_", "a", "b", "c", "d"), F.concat("a", F.initcap("b"), F.initcap("c"), "d"), F.concat_ws("-", "a", "b", "c"), F.concat_ws("_", F.upper("a"), F.upper("b"), "d"), F.concat_ws("/", "a", "b", "c"), F.concat("a", "b", "c"), F.date_format(F.timestamp_seconds(F.col("id") * 864_007), "yyyy-MM-dd'T'HH-mm-ss"))
    return x.select(F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int")).alias("token"), F.lit(0).alias("label"))


#: A token with a letter; from each token's start, in time linear in the token.
_LETTERED = rf"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*+[A-Za-z]){TOKEN}"


def _is_random(token: Column, model: dict[str, float], margin: float) -> Column:
    """Whether a token's mean log-likelihood ratio exceeds the margin."""
    size = len(ALPHABET)
    numbers = ",".join(f"{model[a + b]:.6f}" for a in ALPHABET for b in ALPHABET)
    ratios = F.split(F.lit(numbers), ",").cast("array<double>")  # folded to one literal, read by position
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    sums = _let(places, lambda c: F.aggregate(F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.element_at(ratios, (a - 1) * size + b)), F.lit(0.0), lambda acc, r: acc + r))
    return token.rlike("[A-Za-z]") & (sums > margin * (F.char_length(token) - 1))


def random_spans(text: Column, model: dict[str, float], margin: float = MARGIN) -> Column:
    """Spans of kind `random`: tokens whose mean log-likelihood ratio exceeds the margin."""
    good = F.filter(_pieces(text, TOKEN, "random"), lambda s: _is_random(s["match"], model, margin))
    return F.when(text.rlike(_LETTERED), good).otherwise(F.array().cast(_NONE))


def scan(docs: DataFrame, samples: DataFrame | None = None, margin: float = MARGIN) -> DataFrame:
    """(doc_id, text, base, extra) for every row of `docs` (doc_id, text): arrays of spans (start, end, kind, match).

    Null texts count as empty and have no spans. `base` holds the base patterns' spans, `extra` those the
    models add outside base spans. Repeated rows get equal results, an empty table gives an empty one, null ids
    stay null, other columns aren't read. Without `samples` the models learn from `random_samples` and
    `identifier_samples` of `docs`.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if samples is None:
        samples = random_samples(docs.sparkSession).union(identifier_samples(docs))
    model, text = train(samples), F.col("text")
    kinds = [kind for kind, _, _ in KINDS]
    found = rows.withColumns({kind: spans_of(text, kind) for kind in kinds} | {"more": random_spans(text, model, margin)})
    meets = lambda m: F.when(_meets(F.col(kinds[0]), m), True).when(_meets(F.col(kinds[1]), m), True).otherwise(_meets(F.col(kinds[2]), m))
    return found.select("doc_id", "text", F.concat(*kinds).alias("base"), F.filter("more", lambda m: ~meets(m)).alias("extra"))


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k, _, _ in KINDS], F.lit("random")), kind)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _order(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of `scan`'s rows."""
    kind_of = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kind_of, (lambda k: lambda x: x == k)(k))).cast("long").alias(f"n_{k}") for k, _, _ in KINDS]
    return scanned.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "extra")).alias("spans"))


def _replaced(text: Column, pattern: str, counts, mask: str) -> Column:
    """The text with `mask` for every match that counts."""
    part = lambda b, m: F.concat(b, F.when(m.isNull(), "").when(counts(m), mask).otherwise(m))
    return _let(_cut(text, pattern), lambda x: F.array_join(F.zip_with(x["between"], x["matches"], part), ""))


def _mask_kind(text: Column, kind: str, mask: str) -> Column:
    found = _replaced(text, _LONG[kind], lambda m: _counts(m, kind), mask)
    return F.when(_CHEAP[kind](text) & text.rlike(_LONG[kind]), found).otherwise(text)


def mask_base(text: Column, mask: str) -> Column:
    """The text with `mask` for every base span. Of overlapping spans the first kind as listed goes first."""
    return _let(_let(_mask_kind(text, "assign", mask), lambda t: _mask_kind(t, "access", mask)), lambda t: _mask_kind(t, "hex", mask))


def redact(docs: DataFrame, mask: str = "[SECRET]", margin: float = MARGIN, samples: DataFrame | None = None) -> DataFrame:
    """`docs` with `mask` for every base span, and then for every random token; n_chars follows the text.

    All rows and columns stay, repeated rows too; null texts stay null, an empty table stays empty. Of overlapping
    spans the first kind as listed is masked, then what the others find in the rest.
    """
    if samples is None:
        samples = random_samples(docs.sparkSession).union(identifier_samples(docs))
    model = train(samples)
    random = lambda t: F.when(t.rlike(_LETTERED), _replaced(t, TOKEN, lambda m: _is_random(m, model, margin), mask)).otherwise(t)
    masked = F.when(F.col("text").isNotNull(), _let(mask_base(F.col("text"), mask), random))
    out = docs.withColumn("__graphloom_masked", masked)
    if "n_chars" in docs.columns:
        changed = F.col("__graphloom_masked") != F.col("text")
        out = out.withColumn("n_chars", F.when(changed, F.char_length("__graphloom_masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("__graphloom_masked")).select(*docs.columns)
