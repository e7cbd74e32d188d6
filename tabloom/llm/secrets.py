"""Secret scans with DataFrame functions only: three fixed patterns, and two character Markov models.

One model is of random strings, one of ordinary identifiers; both count transitions between characters in labelled
samples. A long run of token characters, or a part of one, is reported where the log-likelihood ratio of the two is high
enough."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The kinds in the order in which spans of one start are listed, their patterns, and lengths at least.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE, LEAST_ACCESS = 6, 20

#: The characters of the models. Every other character ends a run.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: As many different transitions are no repetition, however many there are in all.
VARIED = 48

#: Parts of ordinary identifiers.
PARTS = """
get set user name list index value table column key file path read write open close start stop count total first last
next previous create update delete insert select from where order group by join left right inner outer customer item
price date time stamp year month day hour minute second size length width height color image text string number integer
double float boolean array map vector matrix model train test valid batch token word line page document section chapter
article comment header footer button window screen display network server client request response error warning message
config option default parameter argument function method class object module package library version release build debug
information international organization development environment management application implementation configuration
the and that with from this have which their there would about other into more these some than only over after because
und der die das nicht mit sich auf eine werden verwaltung einstellung bearbeitung gesellschaft entwicklung schnittstelle
les des une pour dans avec est sur par plus entre depuis toujours maintenant gouvernement environnement developpement
los las una para con por como pero entre hasta desde siempre gobierno desarrollo informacion administracion ciudad
""".split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(text, random): n random strings (base64, its URL form, hexadecimal, upper-case) and n ordinary identifiers
    (parts joined in several styles, rules of one character), all from hashes of their number."""
    i = F.col("id")
    digest = F.sha2(i.cast("string"), 256)
    b64 = F.substring(F.base64(F.unhex(digest)), 1, 40)
    style = F.pmod(i, F.lit(8))
    random = F.when(style < 3, b64).when(style < 5, F.translate(b64, "+/", "-_")).when(style < 7, F.substring(digest, 1, 40)).otherwise(F.upper(F.translate(b64, "+/=", "")))
    words = F.array(*map(F.lit, PARTS))
    part = lambda k: F.element_at(words, (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    four = [part(k) for k in range(4)]
    rule = F.repeat(F.element_at(F.array(*map(F.lit, "-=_+/")), (F.pmod(F.xxhash64(i), F.lit(5)) + 1).cast("int")), 30)
    ordinary = (
        F.when(style == 0, F.concat_ws("_", *four))
        .when(style == 1, F.concat_ws("-", *four))
        .when(style == 2, F.concat_ws("/", *four))
        .when(style == 3, F.concat(four[0], *map(F.initcap, four[1:])))
        .when(style == 4, F.upper(F.concat_ws("_", *four)))
        .when(style == 5, F.concat(F.concat_ws("_", *four[:3]), F.pmod(F.xxhash64(i, F.lit(9)), F.lit(1000)).cast("string")))
        .when((style == 6) & (F.pmod(F.xxhash64(i, F.lit(5)), F.lit(4)) == 0), rule)
        .otherwise(F.concat(*four))
    )
    ids = spark.range(n)
    return ids.select(random.alias("text"), F.lit(True).alias("random")).unionByName(ids.select(ordinary.alias("text"), F.lit(False).alias("random")))


def train(samples: DataFrame, smooth: float = 0.5) -> list[int]:
    """Milli-nats of the log-likelihood ratio of each transition, row by row over the alphabet. The counts are made in
    Spark; what comes to the driver is bounded by the square of the alphabet. Samples with null text don't count."""
    size = len(ALPHABET)
    pairs = samples.select("random", F.explode(F.expr("transform(sequence(1, greatest(length(text) - 1, 1)), i -> substr(text, i, 2))")).alias("pair")).where("length(pair) = 2")
    counts = pairs.groupBy("random", "pair").agg(F.count("*").alias("n"))
    inside = F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")
    found = {(r[0], r[1]): r[2] for r in counts.where(inside).toLocalIterator()}
    ratios = []
    for a in ALPHABET:
        rows = [[found.get((label, a + b), 0) + smooth for b in ALPHABET] for label in (True, False)]
        sums = [sum(r) for r in rows]
        ratios += [round(1000 * math.log(x / sums[0] / (y / sums[1]))) for x, y in zip(*rows, strict=True)]
    assert len(ratios) == size * size
    return ratios


#: Matches whose places are added up at a time: appending to an array copies it, so that longer ones would take time that
#: grows with their square.
STEP = 128


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str, group: int) -> str:
    """SQL for an array of (b, w, g): what lies before each leftmost non-overlapping match, the match, its group; at last
    what lies behind them, with nulls."""
    p = _quoted(pattern)
    parts = [f"split({text}, {p}, -1)", f"regexp_extract_all({text}, {p}, 0)", *([f"regexp_extract_all({text}, {p}, {group})"] if group else [])]
    return f"transform(arrays_zip({', '.join(parts)}), z -> named_struct('b', z['0'], 'w', z['1'], 'g', z['{2 if group else 1}']))"


def _let(value: str, name: str, body: str) -> str:
    """SQL of body, in which name stands for the value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _located(text: str, pattern: str, group: int = 0) -> str:
    """SQL for an array of (lo, hi, g) of all leftmost non-overlapping matches: what lies between them has the lengths
    that their positions need. Empty without a match, so that most texts cost one search."""
    none = "array_repeat(named_struct('lo', 0, 'hi', 0, 'g', ''), 0)"
    hi = "s.at + length(m.b) + length(m.w)"
    one = f"(s, m) -> if(m.w is null, s, named_struct('at', {hi}, 'out', array_append(s.out, named_struct('lo', s.at + length(m.b), 'hi', {hi}, 'g', m.g))))"
    some = f"aggregate(slice(o, c, {STEP}), named_struct('at', y.at, 'out', {none}), {one})"
    walk = f"aggregate(sequence(1, size(o), {STEP}), named_struct('at', 0, 'out', array_repeat({none}, 0)), (y, c) -> {_let(some, 'r', 'named_struct(' + repr('at') + ', r.at, ' + repr('out') + ', array_append(y.out, r.out))')}, y -> flatten(y.out))"
    return f"if({text} rlike {_quoted(pattern)}, {_let(_matches(text, pattern, group), 'o', walk)}, {none})"


def _blanked(text: str, pattern: str, least: int = 0, group: int = 0) -> str:
    """SQL for the text with blanks for all matches whose group has at least so many characters."""
    parts = f"transform({_matches(text, pattern, group)}, m -> concat(m.b, if(m.w is null, '', if(length(m.g) >= {least}, repeat(' ', length(m.w)), m.w))))"
    return f"if({text} rlike {_quoted(pattern)}, array_join({parts}, ''), {text})"


def _random(run: str, ratios: list[int], least: int, threshold: int) -> str:
    """SQL for an array of (lo, hi): the whole run where its log-likelihood ratio is high enough, else parts of it."""
    size = len(ALPHABET)
    table = "array(" + ",".join(map(str, ratios)) + ")"
    place = f"(locate(a, '{ALPHABET}') - 1) * {size} + locate(b, '{ALPHABET}') - 1"
    steps = f"filter(zip_with(c, slice(c, 2, size(c)), (a, b) -> if(b is null, -1, {place})), p -> p >= 0)"
    llr = "aggregate(t, cast(0 as bigint), (s, p) -> s + w[p])"
    body = f"if({llr} >= {threshold} and {_varied('t')}, array(named_struct('lo', {run}.lo, 'hi', {run}.hi)), {_parts(run, 'w', least, threshold)})"
    return _let(table, "w", _let(f"split({run}.g, '')", "c", _let(steps, "t", body)))


def _varied(steps: str) -> str:
    """SQL for whether at least half of the transitions, or VARIED of them, are different ones: else they repeat."""
    return f"size(array_distinct({steps})) >= least(size({steps}) div 2, {VARIED})"


def _parts(run: str, table: str, least: int, threshold: int) -> str:
    """SQL for an array of (lo, hi): the stretches of the run with the transitions t whose log-likelihood ratio is a
    running maximum of at least threshold. A stretch ends where the sum falls to zero, or by threshold below its maximum.
    What is found is widened to whole letters and digits."""
    none = "array_repeat(named_struct('lo', 0, 'hi', 0), 0)"
    out = f"if(s.best >= {threshold}, array_append(s.out, named_struct('lo', s.lo, 'hi', s.hi)), s.out)"
    zero = "cast(0 as bigint)"
    now = f"s.sum + {table}[p]"
    over = f"{now} <= 0 or {now} <= s.best - {threshold}"
    step = f"if({over}, named_struct('i', s.i + 1, 'sum', {zero}, 'lo', s.i + 1, 'best', {zero}, 'hi', 0, 'out', {out}), named_struct('i', s.i + 1, 'sum', {now}, 'lo', s.lo, 'best', greatest(s.best, {now}), 'hi', if({now} > s.best, s.i + 2, s.hi), 'out', s.out))"
    found = f"aggregate(t, named_struct('i', 0, 'sum', {zero}, 'lo', 0, 'best', {zero}, 'hi', 0, 'out', {none}), (s, p) -> {step}, s -> {out})"
    varied = f"filter({found}, y -> {_varied('slice(t, y.lo + 1, y.hi - y.lo - 1)')})"
    lo = f"{run}.lo + y.lo + 1 - length(regexp_extract(reverse(substr({run}.g, 1, y.lo + 1)), '^[A-Za-z0-9]*', 0))"
    hi = f"{run}.lo + y.hi - 1 + length(regexp_extract(substr({run}.g, y.hi), '^[A-Za-z0-9]*={{0,2}}', 0))"
    return f"array_distinct(filter(transform({varied}, y -> named_struct('lo', {lo}, 'hi', {hi})), y -> y.hi - y.lo >= {least}))"


def scan(docs: DataFrame, ratios: list[int], least_run: int = 20, threshold: int = 15_000, into: str = "secrets") -> DataFrame:
    """docs' columns and, last, `into`: an array of (start, kind, end) by start, then kind (an index of KINDS); code
    points, end exclusive. A column of docs that has that name is an error, so that none is lost: name another.

    assign, access and hex are the fixed patterns. markov: of what is left when their matches are blanked out, of each run
    of at least least_run characters of the alphabet, the whole where its log-likelihood ratio is at least threshold
    milli-nats, else the parts where it is; what repeats a few transitions is not random. A null or empty text has no
    spans; null ids and repeated rows stay as they are; an empty table gives an empty one. Time grows with the length of
    a text, whatever the number of its spans."""
    if into in docs.columns:
        raise ValueError(f"docs have a column {into}")
    own, blank = f"{into}_scan_text", f"{into}_scan_blanked"
    while {own, blank} & set(docs.columns):
        own, blank = own + "_", blank + "_"
    kind = lambda k, spans: F.expr(f"transform({spans}, x -> named_struct('start', x.lo, 'kind', {k}, 'end', x.hi))")
    base = F.concat(
        kind(0, f"filter({_located(own, ASSIGN, 2)}, x -> length(x.g) >= {LEAST_VALUE})"),
        kind(1, f"filter({_located(own, ACCESS)}, x -> length(x.g) >= {LEAST_ACCESS})"),
        kind(2, _located(own, HEX)),
    )
    runs = f"flatten(transform({_located(blank, '[A-Za-z0-9+/_=-]{%d,}' % least_run)}, r -> {_random('r', ratios, least_run, threshold)}))"
    named = docs.withColumn(own, F.coalesce(F.col("text"), F.lit("")))
    for pattern, least, group in ((ASSIGN, LEAST_VALUE, 2), (ACCESS, LEAST_ACCESS, 0), (HEX, 0, 0)):
        named = named.withColumn(blank, F.expr(_blanked(own if blank not in named.columns else blank, pattern, least, group)))
    return named.withColumn(into, F.array_sort(F.concat(base, kind(3, runs)))).drop(own, blank)


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame, column: str = "secrets") -> DataFrame:
    """The contract's columns."""
    n = lambda k: F.size(F.filter(column, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = F.filter(column, lambda s: s["kind"] < 3)
    return scanned.select(F.col("doc_id").cast("long").alias("doc_id"), n(0), n(1), n(2), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col(column)).alias("spans"))


def redact(scanned: DataFrame, mark: str = "[SECRET]", column: str = "secrets") -> DataFrame:
    """Each stretch of touching or overlapping spans of the text becomes one mark; a text without secrets stays as it
    is, null too. All columns stay."""
    none = "array_repeat(named_struct('lo', 0, 'hi', 0), 0)"
    one = "(s, x) -> named_struct('at', greatest(s.at, x.end), 'out', if(x.start > s.at, array_append(s.out, named_struct('lo', greatest(s.at, 0), 'hi', x.start)), s.out))"
    some = f"aggregate(slice(`{column}`, c, {STEP}), named_struct('at', y.at, 'out', {none}), {one})"
    step = _let(some, "r", "named_struct('at', r.at, 'out', array_append(y.out, r.out))")
    gaps = f"aggregate(sequence(1, size(`{column}`), {STEP}), named_struct('at', -1, 'out', array_repeat({none}, 0)), (y, c) -> {step}, y -> array_append(flatten(y.out), named_struct('lo', y.at, 'hi', length(text))))"
    # bytes are reached at once, characters of other texts by walking to them
    join = lambda part: f"array_join(transform({gaps}, z -> {part}), '{mark}')"
    bytes_ = _let("cast(text as binary)", "v", join("cast(substr(v, z.lo + 1, z.hi - z.lo) as string)"))
    built = F.expr(f"if(length(text) = octet_length(text), {bytes_}, {join('substr(text, z.lo + 1, z.hi - z.lo)')})")
    return scanned.withColumn("text", F.when(F.size(column) > 0, built).otherwise(F.col("text")))
