"""Secrets in texts: three fixed patterns, and strings that pass a battery of randomness tests
(operator 2, DataFrame functions only).

Patterns. assign: a keyword, a sign and a value of 8 or more characters; access: an access key of 16 or
more; hex: 32 or more hexadecimal digits. Matches are leftmost and do not overlap within a kind.

Battery. Candidates are runs of 20 or more key characters, by the encoding that their character set fits
(hex, base 32 and base 36 in either case, base 64 with either pair of signs; strings without digits have
encodings of their own); digits and signs alone are none. Their symbols, as numbers of the encoding's alphabet, are
put to three tests of the hypothesis "drawn evenly at random": a chi-squared test of uniform use of the
alphabet, a runs test about its middle, and the serial correlation of neighbours. The three scores give
one p-value, which is uniform for keys and near zero for words, paths and identifiers.

Control. Short strings leave the tests little power, so the share of ordinary strings among those
accepted is estimated by encoding and class of length over the whole table: p-values above one half
come from keys, which tells how many keys there are, and the rest of what a cut-off accepts is false. In the
encodings of words and names a share of these (``WORDY_HIGH``) is taken to have such p-values too, so a class
in which words prevail accepts nothing. A class with few keys leans on what is usual, so that a lone key in a
table of prose is found too.
Each class takes the lowest cut-off whose share of false discoveries is at most ``FALSE_SHARE``, or
accepts nothing. Accepted strings that touch no span of a pattern are reported as kind random.

Defined cases: null and empty texts have no spans; any other column is kept or ignored; every row is
judged on its own text, so ties and repeated rows get equal spans; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The patterns to report, in the order of their kinds.
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
FALSE_SHARE = 0.05
STEPS = 100
# Where a stratum has few keys: how many p-values above one half count as much as all prior belief, and the
# share of ordinary strings with p-values below and from LOWEST_CUT steps on, in other encodings and in wordy ones.
TRUSTED, LOWEST_CUT = 200, 3
ORDINARY = ((0.1, 0.02), (0.3, 0.1))
MASK = "[SECRET]"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": _UPPER + "234567",
    "base36": _UPPER + "0123456789",
    "base64": _UPPER + _UPPER.lower() + "0123456789+/",
    "letters": _UPPER,
    "mixed": _UPPER + _UPPER.lower() + "+/",
}
# Encodings tested in the alphabet of another one, and those that are tested in upper case.
ALIKE = {"base32l": "base32", "base36l": "base36", "other": "base64"}
RAISED = ("base32l", "base36l", "letters")
# Encodings of words and names, of which up to this share has p-values above one half.
WORDY, WORDY_HIGH = ("letters", "mixed", "other"), 0.05
_SPANS = "array<struct<start:int,end:int,kind:int,value:string>>"


def _found(text: Column, pattern: str, kind: int, long_enough) -> Column:
    """Spans of all matches: the text between matches tells where each begins."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["between"])
        end = start + F.length(pair["hits"])
        span = F.struct(
            start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), pair["hits"].alias("value")
        )
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))
    pairs = F.arrays_zip(F.slice(between, 1, F.size(hits)).alias("between"), hits.alias("hits"))
    spans = F.aggregate(pairs, begin, step, lambda state: state["spans"])
    kept = F.filter(spans, lambda s: long_enough(s["value"]))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast(_SPANS))


def pattern_spans(text: Column) -> Column:
    """Spans of the three patterns, by start and kind."""
    value = lambda hit: F.regexp_extract(hit, ASSIGN, 2)
    return F.array_sort(
        F.concat(
            _found(text, ASSIGN, 0, lambda hit: F.length(value(hit)) >= 8),
            _found(text, ACCESS, 1, lambda hit: F.length(hit) >= 16),
            _found(text, HEX, 2, lambda hit: F.length(hit) >= 32),
        )
    )


def encoding(value: Column) -> Column:
    """The encoding a string seems to be in, null for digits alone. What words and names look like too has
    encodings of its own, so that these do not blur the rest: letters of one case, mixed letters without
    digit, and what else has signs or a first capital only. Keys without digits are even over the letters."""
    body = F.rtrim(value, F.lit("="))
    digit = body.rlike("[0-9]")
    mixed = body.rlike("[a-z]") & body.rlike(".[A-Z]")
    return (
        F.when(body.rlike("^[0-9+/_-]*$"), F.lit(None).cast("string"))
        .when(digit & body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(digit & body.rlike("^[A-Z2-7]+$"), "base32")
        .when(digit & body.rlike("^[a-z2-7]+$"), "base32l")
        .when(digit & body.rlike("^[A-Z0-9]+$"), "base36")
        .when(digit & body.rlike("^[a-z0-9]+$"), "base36l")
        .when(body.rlike("^([A-Z]+|[a-z]+)$"), "letters")
        .when(digit & mixed, "base64")
        .when(mixed, "mixed")
        .otherwise("other")
    )


def _tail(score: Column) -> Column:
    """P(normal > score) for a score of zero or more, to about 0.0002."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(score * score * score * 0.07056 + score * 1.5976))


def _alphabet(name: Column) -> Column:
    alphabet = F.lit(ALPHABETS["base64"])
    for other in ("hex", "base32", "base36", "letters", "mixed"):
        names = [other, *(c for c, plain in ALIKE.items() if plain == other)]
        alphabet = F.when(name.isin(names), ALPHABETS[other]).otherwise(alphabet)
    return alphabet


def _body(value: Column, name: Column) -> Column:
    body = F.rtrim(F.translate(value, "-_", "+/"), F.lit("="))
    return (
        F.when(name == "hex", F.lower(body))
        .when(name.isin(*RAISED), F.upper(body))
        .otherwise(body)
    )


def p_value(body: Column, alphabet: Column) -> Column:
    """How likely three scores as bad as these are for even random symbols of the alphabet."""
    n, k = F.length(body).cast("double"), F.length(alphabet).cast("double")
    symbols = F.regexp_extract_all(alphabet, F.lit("."), F.lit(0))
    places = F.transform(
        F.regexp_extract_all(body, F.lit("."), F.lit(0)),
        lambda c: (F.instr(alphabet, c) - 1).cast("double"),
    )
    zero = F.lit(0.0)

    squares = F.aggregate(
        F.transform(symbols, lambda c: F.length(body) - F.length(F.replace(body, c, F.lit("")))),
        zero,
        lambda total, count: total + count * count,
    )
    chi = k / n * squares - n
    chi_score = (chi - (k - 1)) / F.sqrt((k - 1) * 2 * (n - 1) / n)

    def walk(state: Column, x: Column) -> Column:
        high = (x >= k / 2).cast("double")
        d = x - (k - 1) / 2
        return F.struct(
            (state["high"] + high).alias("high"),
            (state["runs"] + (high != state["last"]).cast("double")).alias("runs"),
            high.alias("last"),
            (state["sum"] + d).alias("sum"),
            (state["square"] + d * d).alias("square"),
            (state["product"] + d * F.when(state["runs"] == 0, 0.0).otherwise(state["d"])).alias("product"),
            d.alias("d"),
        )

    names = ("high", "runs", "last", "sum", "square", "product", "d")
    begin = F.struct(*(F.lit(-1.0 if c == "last" else 0.0).alias(c) for c in names))

    def finish(state: Column) -> Column:
        high, low = state["high"], n - state["high"]
        pairs = high * low * 2
        runs_score = F.when(
            (high > 0) & (low > 0),
            F.abs(state["runs"] - (pairs / n + 1))
            / F.sqrt(F.greatest(pairs * (pairs - n) / (n * n * (n - 1)), F.lit(1e-9))),
        ).otherwise(9.0)
        mean = state["sum"] / n
        spread = state["square"] - n * mean * mean
        along = state["product"] - (n - 1) * mean * mean
        serial_score = F.when(
            spread > 1e-9, F.abs(along / spread + F.lit(1.0) / n) * F.sqrt(n)
        ).otherwise(9.0)
        return runs_score * runs_score + serial_score * serial_score

    total = F.least(chi_score * chi_score + F.aggregate(places, begin, walk, finish), F.lit(200.0))
    root = F.sqrt(total)
    return F.least(_tail(root) * 2 + F.sqrt(total * 0.6366197723675814) * F.exp(-total / 2), F.lit(1.0))


def _candidates(text: Column) -> Column:
    """Spans of candidates with their stratum (encoding and class of length) and p-value."""
    spans = _found(text, CANDIDATE, 3, lambda hit: encoding(hit).isNotNull())
    # One step at a time, so that each is computed once for a candidate and not for each symbol.
    plain = lambda s: (s["start"], s["end"], s["kind"], s["value"])
    named = F.transform(spans, lambda s: F.struct(*plain(s), encoding(s["value"]).alias("name")))
    ready = F.transform(
        named,
        lambda s: F.struct(
            *plain(s),
            F.concat(
                s["name"], F.lit(":"),
                F.floor(F.log2(F.length(s["value"]).cast("double")) * 2).cast("string"),
            ).alias("stratum"),
            _alphabet(s["name"]).alias("alphabet"),
            _body(s["value"], s["name"]).alias("body"),
        ),
    )
    return F.transform(
        ready,
        lambda s: F.struct(*plain(s), s["stratum"], p_value(s["body"], s["alphabet"]).alias("p")),
    )


def cut_offs(docs: DataFrame) -> dict[str, float]:
    """The lowest accepted p-value of each stratum, from all candidates of the table.

    The strata are encodings by classes of length, and p-values are counted in steps, so what reaches
    the driver is a few hundred counts whatever the size of the table.
    """
    found = docs.select(F.explode(_candidates(F.col("text"))).alias("c"))
    step = F.least(F.floor(F.col("c.p") * STEPS), F.lit(STEPS - 1)).cast("int")
    counts = found.groupBy(F.col("c.stratum").alias("stratum"), step.alias("step")).count().collect()
    by: dict[str, list[int]] = {}
    for row in counts:
        by.setdefault(row.stratum, [0] * STEPS)[row.step] += row["count"]
    cuts = {stratum: _cut_off(stratum.split(":")[0] in WORDY, steps) for stratum, steps in by.items()}
    return {stratum: cut for stratum, cut in cuts.items() if cut is not None}


def _cut_off(wordy: bool, steps: list[int]) -> float | None:
    """The lowest p-value from which at most ``FALSE_SHARE`` of a stratum's candidates are ordinary strings.

    What the p-values above one half tell of the number of keys is trusted as it grows past ``TRUSTED`` of
    them. Below that the number of false ones is rather what ordinary strings elsewhere have such
    p-values by (``ORDINARY``), unless the p-values at hand exceed those of keys beyond chance.
    """
    high = sum(steps[STEPS // 2 :])
    if wordy:
        words = max(0.0, (sum(steps) - 2 * high) / (1 - 2 * WORDY_HIGH))
        high = max(0.0, high - WORDY_HIGH * words)
    keys, trust = 2.0 * high, high / (high + TRUSTED)
    ordinary = max(0.0, sum(steps) - keys)
    for cut in range(1, STEPS // 2 + 1):
        accepted = sum(steps[cut:])
        measured = accepted - keys * (1 - cut / STEPS)
        usual = ordinary * ORDINARY[wordy][cut >= LOWEST_CUT]
        guessed = max(usual, measured - 2 * accepted**0.5)
        if accepted and trust * measured + (1 - trust) * guessed <= FALSE_SHARE * accepted:
            return cut / STEPS
    return None


def secret_spans(text: Column, cuts: dict[str, float]) -> Column:
    """All spans of a text as (start, end, kind, value), by start and kind."""
    text = F.coalesce(text, F.lit(""))
    base = pattern_spans(text)
    limit = F.lit(2.0)
    random = F.array().cast(_SPANS)
    if cuts:
        table = F.create_map(*(F.lit(x) for pair in sorted(cuts.items()) for x in pair))
        accepted = F.filter(
            _candidates(text),
            lambda s: s["p"] >= F.coalesce(F.element_at(table, s["stratum"]), limit),
        )
        random = F.transform(
            accepted, lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"])
        ).cast(_SPANS)
    alone = F.filter(
        random,
        lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return F.array_sort(F.concat(base, alone))


def scan(docs: DataFrame, column: str = "secret_spans") -> DataFrame:
    """The rows with the spans of their texts."""
    return docs.withColumn(column, secret_spans(F.col("text"), cut_offs(docs)))


def report(docs: DataFrame) -> DataFrame:
    """Counts and places of the secrets of each document."""
    spans = F.col("_spans")

    def count(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    def listed(array: Column) -> Column:
        kinds = F.array(*map(F.lit, KINDS))
        parts = F.transform(
            array,
            lambda s: F.concat_ws(
                ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        )
        return F.array_join(parts, ",")

    return scan(docs.select("doc_id", "text"), "_spans").select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(listed(F.filter(spans, lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each secret masked, and n_chars of the new text where there is that column.
    Spans that overlap are masked as one."""
    text, spans = F.col("text"), F.col("_spans")

    def step(state: Column, s: Column) -> Column:
        inside = s["start"] < state["at"]
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        grown = F.when(inside, state["out"]).otherwise(F.concat(state["out"], gap, F.lit(MASK)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), grown.alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(
        spans,
        begin,
        step,
        lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))),
    )
    out = scan(docs, "_spans").withColumn("_new", F.when(F.size(spans) > 0, masked).otherwise(text))
    columns = [F.col("_new").alias("text") if c == "text" else F.col(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        at = docs.columns.index("n_chars")
        changed = F.when(F.size(spans) > 0, F.length("_new").cast(kind)).otherwise(F.col("n_chars"))
        columns[at] = changed.alias("n_chars")
    return out.select(*columns)
