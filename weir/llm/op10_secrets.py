"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Both models are first-order chains over the characters of a candidate, fitted with DataFrame operations to
labelled samples; their log ratios form one table of len(ALPHABET) + 1 squared numbers, which is all that the
driver gets and all that scoring needs. Scoring is a projection of each row by built-in functions: no shuffle,
no join and no Python, so rows of any key or size run where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.session import table

#: Fixed values of the contract, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # runs are maximal, so the same as + with a check of the length afterwards
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A candidate has so many characters at least, and a mean log ratio of so many nats a step.
CANDIDATE, MARGIN = "[A-Za-z0-9+/_=-]{20,}", 0.3

#: Ordinary identifiers are joined from these.
VOCABULARY = """
account action active address agent alert amount analysis api application archive array article attribute audit
author available average balance batch before billing block body boolean border branch browser buffer build bundle
button cache callback cancel category center change channel character check child class client cluster code column
command comment common company component compute condition config connection constant container content context
control convert count counter country create current cursor customer data database date default delete delivery
description destination detail device dialog directory display document domain download duration dynamic edit
element email enable encoding engine entity entry environment error event example exception execute expression
external factory feature field file filter finish first folder format frame function general generate global graph
group handler header height history host identifier image import index information initial input insert instance
integer interface internal invoice item iterator keyboard language last layout length level library license limit
listener local location logger machine manager mapping margin master match maximum member memory message method
metric minimum model module monitor mouse name network node notification number object offset operation option order
output owner package page panel parameter parent parser partition password path pattern payment performance
permission person picture pixel player plugin policy position prefix previous price primary print priority private
process product profile program project property protocol provider public query queue random range reader record
reference region register release remote remove render report repository request resource response result return
root router sample schedule schema screen script search second section security select sender sequence serial server
service session setting shadow shape shipping signal simple single source stack standard start state statement
static status storage stream string structure style submit subscription summary support switch symbol system table
target task template terminal test text theme thread time timeout title token total transaction transform tree type
unit update upload user utility validate value variable vector version view virtual visible volume warning widget
width window worker wrapper write
gesellschaft verantwortung entwicklung geschwindigkeit wissenschaft unterstützung veröffentlichung zusammenarbeit
développement environnement gouvernement administration responsabilité communication établissement fonctionnement
desarrollo administración universidad conocimiento establecimiento responsabilidad funcionamiento comunicación
""".split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(token, random): n strings of either kind, the same in every run."""
    ids = spark.range(n)
    digest = F.sha2(F.col("id").cast("string"), 256)
    coded = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    random = ids.select(F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 4 == 1, F.substring(F.upper(F.regexp_replace(coded, "[+/]", "")), 1, 32)).otherwise(coded).alias("token"), F.lit(True).alias("random"))
    words = F.array(*(F.lit(w) for w in VOCABULARY))

    def pick(k: int) -> Column:
        return F.element_at(words, ((F.col("id") * 7919 + F.col("id") * F.col("id") * (31 + 2 * k) + k * 104729) % len(VOCABULARY) + 1).cast("int"))

    a, b, c = pick(1), pick(2), pick(3)
    style = F.col("id") % 6
    name = (
        F.when(style == 0, F.concat_ws("_", a, b, c)).when(style == 1, F.concat(a, F.initcap(b), F.initcap(c))).when(style == 2, F.concat_ws("-", a, b, c))
        .when(style == 3, F.concat_ws("/", a, b, F.concat(c, (F.col("id") % 10).cast("string")))).when(style == 4, F.upper(F.concat_ws("_", a, b, c))).otherwise(F.concat(a, b, c))
    )
    return random.union(ids.select(name.alias("token"), F.lit(False).alias("random")))



def train_markov(samples: DataFrame) -> list[float]:
    """Log ratios of steps (random to ordinary) by 68 * code + code, with one added to every count; samples: (token, random)."""
    size = len(ALPHABET) + 1
    steps = samples.where("token is not null and length(token) > 1").select("random", F.explode(F.expr("transform(sequence(1, length(token) - 1), i -> substring(token, i, 2))")).alias("step"))
    coded = steps.select("random", F.expr(f"instr('{ALPHABET}', substring(step, 1, 1))").alias("a"), F.expr(f"instr('{ALPHABET}', substring(step, 2, 1))").alias("b"))
    pairs = coded.groupBy("a", "b").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    rows = coded.groupBy("a").agg(F.count_if("random").alias("ra"), F.count_if(~F.col("random")).alias("oa"))
    codes = samples.sparkSession.range(size)
    grid = codes.select(F.col("id").cast("int").alias("a")).join(F.broadcast(codes.select(F.col("id").cast("int").alias("b"))), how="cross")
    grid = grid.join(pairs, ["a", "b"], "left").join(rows, "a", "left").na.fill(0)
    ratio = F.log((F.col("r") + 1) / (F.col("ra") + size)) - F.log((F.col("o") + 1) / (F.col("oa") + size))
    return [x[0] for x in grid.select(F.round(ratio, 6).alias("x"), "a", "b").orderBy("a", "b").select("x").collect()]


#: Entries of an array that are summed one after the other; code points of a piece of text that is cut.
RUN, PIECE = 256, 4096


def _running(array: str, step: str) -> str:
    """SQL of the running results of step (sum or greatest of x and y) over an array of numbers that are 0 or more, in runs, as appending copies an array."""
    both = {"sum": "({} + {})", "greatest": "greatest({}, {})"}[step].format
    runs = f"transform(sequence(0, (size(whole) - 1) div {RUN}), c -> slice(whole, c * {RUN} + 1, {RUN}))"
    totals = f"transform(runs, p -> aggregate(p, 0, (x, y) -> {both('x', 'y')}))"

    def one_by_one(start: str, array: str, value: str) -> str:
        """Results before (a.at) or with (the step) each entry of a short array."""
        return f"aggregate({array}, named_struct('at', {start}, 'out', cast(array() as array<int>)), (a, y) -> named_struct('at', {both('a.at', 'y')}, 'out', array_append(a.out, {value})), a -> a.out)"

    each = f"zip_with(runs, {one_by_one('0', totals, 'a.at')}, (p, v) -> {one_by_one('v', 'p', both('a.at', 'y'))})"
    return f"transform(array({array}), whole -> transform(array({runs}), runs -> flatten({each}))[0])[0]"


def _found(kind: str, pattern: str, fits: str = "true", group: int = 0) -> str:
    """SQL of an array of (start, kind, end, v) for the matches of pattern in t; v is the group's text and may be tested in fits."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    k = KINDS.index(kind)
    ends = _running("transform(sequence(0, size(m.all) - 1), i -> length(m.gaps[i]) + length(m.all[i]))", "sum")
    spans = f"transform(array({ends}), ends -> transform(sequence(0, size(m.all) - 1), i -> named_struct('s', ends[i] - length(m.all[i]), 'k', {k}, 'e', ends[i], 'v', m.vals[i])))[0]"
    return f"""case when t rlike '{p}' then filter(transform(array(named_struct('all', regexp_extract_all(t, '{p}', 0), 'vals', regexp_extract_all(t, '{p}', {group}), 'gaps', split(t, '{p}', -1))), m -> {spans})[0], x -> {fits}) else cast(array() as array<struct<s:int,k:int,e:int,v:string>>) end"""


def _joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform(array_sort({spans}), x -> concat(array({names})[x.k], ':', cast(x.s as string), ':', cast(x.e as string))), ',')"


def scan_secrets(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """docs with t, n_assign, n_access, n_hex, base (array of spans) and more (the method's spans); docs: (text, ...).

    A span is (s, k, e, v): start and end in code points, end exclusive, index of its kind, its text (of an assign
    span the assigned value). The method's spans are candidates with letters and digits whose mean log ratio is
    MARGIN or more and that overlap no span of the base. A null text counts as empty.
    """
    size = len(ALPHABET) + 1
    model = F.array(*(F.lit(float(x)) for x in ratios))
    out = docs.withColumn("t", F.coalesce(F.col("text"), F.lit("")))
    out = out.withColumn("b1", F.expr(_found("assign", ASSIGN, "length(x.v) >= 6", 2))).withColumn("b2", F.expr(_found("access", ACCESS))).withColumn("b3", F.expr(_found("hex", HEX)))
    out = out.withColumn("base", F.concat("b1", "b2", "b3"))
    out = out.withColumn("n_assign", F.size("b1").cast("long")).withColumn("n_access", F.size("b2").cast("long")).withColumn("n_hex", F.size("b3").cast("long"))
    mixed = "x.v rlike '[0-9]' and x.v rlike '[A-Za-z]'"
    out = out.withColumn("c", F.expr(_found("markov", CANDIDATE, mixed)))
    # Pieces of a long candidate overlap by a character, so that each step is in one of them.
    pieces = f"regexp_extract_all(x.v, '(?=(.{{1,{RUN + 1}}})).{{1,{RUN}}}', 1)"
    steps = f"""aggregate(sequence(1, length(p) - 1), 0D, (acc, i) -> acc + model[instr('{ALPHABET}', substring(p, i, 1)) * {size} + instr('{ALPHABET}', substring(p, i + 1, 1))])"""
    mean = f"aggregate(filter({pieces}, p -> length(p) > 1), 0D, (acc, p) -> acc + {steps}) / (length(x.v) - 1)"
    # Spans of the base that begin before a candidate ends are counted by halving; the furthest end of these must not lie behind its start.
    mid = "shiftright(a.lo + a.hi, 1)"
    half = f"case when a.lo >= a.hi then a when b[{mid}].s < x.e then named_struct('lo', {mid} + 1, 'hi', a.hi) else named_struct('lo', a.lo, 'hi', {mid}) end"
    begun = f"aggregate(sequence(1, cast(ceil(log2(size(b) + 1)) as int) + 1), named_struct('lo', 0, 'hi', size(b)), (a, i) -> {half}, a -> a.lo)"
    apart = f"transform(array({begun}), n -> case when n = 0 then true else far[n - 1] <= x.s end)[0]"
    alone = f"transform(array(array_sort(base)), b -> transform(array({_running('transform(b, y -> y.e)', 'greatest')}), far -> filter(c, x -> {apart})))[0][0]"
    # The model is a constant of a small projection: only rows with candidates touch it.
    out = out.withColumn("model", model)
    return out.withColumn("more", F.expr(f"case when size(c) > 0 then filter(case when size(base) > 0 then {alone} else c end, x -> {mean} >= {MARGIN}) else c end")).drop("b1", "b2", "b3", "c", "model")


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), train_markov(labelled_samples(spark)))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.expr(_joined("base")).cast("binary"), 256).alias("base_sha256"), F.expr(_joined("concat(base, more)")).alias("spans"))


def redact(docs: DataFrame, ratios: list[float], mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by mark in text (spans that overlap are replaced as one); n_chars follows where docs has it."""
    names = docs.columns
    far = _running("transform(a, x -> x.e)", "greatest")
    heads = "filter(sequence(0, size(a) - 1), i -> case when i = 0 then true else a[i].s >= m[i - 1] end)"
    spans = "transform(sequence(0, size(h) - 1), j -> named_struct('s', a[h[j]].s, 'e', m[case when j + 1 < size(h) then h[j + 1] - 1 else size(a) - 1 end]))"
    merged = f"transform(array(array_sort(concat(base, more))), a -> transform(array({far}), m -> transform(array({heads}), h -> {spans})[0])[0])[0]"

    def part(lo: str, hi: str) -> str:
        cut = f"substring(pieces[c], greatest({lo} - c * {PIECE}, 0) + 1, least({hi} - c * {PIECE}, {PIECE}) - greatest({lo} - c * {PIECE}, 0))"
        return f"case when {lo} < {hi} then array_join(transform(sequence({lo} div {PIECE}, ({hi} - 1) div {PIECE}), c -> {cut}), '') else '' end"

    before = part("(case when j = 0 then 0 else r[j - 1].e end)", "r[j].s")
    clean = f"transform(array(regexp_extract_all(t, '(?s).{{1,{PIECE}}}', 0)), pieces -> concat(array_join(transform(sequence(0, size(r) - 1), j -> concat({before}, '{mark}')), ''), {part('r[size(r) - 1].e', 'length(t)')}))[0]"
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("text").alias("text"))
    out = scan_secrets(inner, ratios)
    text = F.expr(f"case when size(base) + size(more) > 0 then transform(array({merged}), r -> {clean})[0] else text end")
    out = out.withColumn("new_text", text)
    cols = {"text": F.col("new_text")}
    if "n_chars" in names:
        cols["n_chars"] = F.when(F.size("base") + F.size("more") > 0, F.length("new_text").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*(cols.get(c, F.col(f"row.`{c}`")).alias(c) for c in names))


def _sql_found(kind: str, pattern: str, fits: str = "true", group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {KINDS.index(kind)} AS k, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e, v FROM (
      SELECT doc_id, m, v, sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
        SELECT doc_id, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (
          SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS vs, regexp_split_to_array(t, '{p}') AS gs FROM d WHERE regexp_matches(t, '{p}')))
      WINDOW w AS (PARTITION BY doc_id ORDER BY i)) x WHERE {fits}"""


_SIZE = len(ALPHABET) + 1
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
vocab AS (SELECT [{", ".join(f"'{w}'" for w in VOCABULARY)}] AS w),
ids AS (SELECT range AS id, sha256(CAST(range AS VARCHAR)) AS h, replace(to_base64(unhex(sha256(CAST(range AS VARCHAR)))), '=', '') AS c FROM range(4000)),
picked AS (SELECT id, {", ".join(f"w[(id * 7919 + id * id * {31 + 2 * k} + {k} * 104729) % {len(VOCABULARY)} + 1] AS {n}" for k, n in ((1, "a"), (2, "b"), (3, "c")))} FROM ids, vocab),
samples AS (
  SELECT CASE id % 4 WHEN 0 THEN h[1:40] WHEN 1 THEN upper(regexp_replace(c, '[+/]', '', 'g'))[1:32] ELSE c END AS token, true AS random FROM ids
  UNION ALL SELECT CASE id % 6 WHEN 0 THEN a || '_' || b || '_' || c WHEN 1 THEN a || upper(b[1:1]) || b[2:] || upper(c[1:1]) || c[2:] WHEN 2 THEN a || '-' || b || '-' || c
    WHEN 3 THEN a || '/' || b || '/' || c || (id % 10) WHEN 4 THEN upper(a || '_' || b || '_' || c) ELSE a || b || c END, false FROM picked),
steps AS (SELECT random, instr('{ALPHABET}', token[i:i]) AS a, instr('{ALPHABET}', token[i + 1:i + 1]) AS b FROM (SELECT random, token, unnest(range(1, length(token))) AS i FROM samples)),
pairs AS (SELECT a, b, count(*) FILTER (WHERE random) AS r, count(*) FILTER (WHERE NOT random) AS o FROM steps GROUP BY a, b),
firsts AS (SELECT a, count(*) FILTER (WHERE random) AS ra, count(*) FILTER (WHERE NOT random) AS oa FROM steps GROUP BY a),
model AS (SELECT x.range AS a, y.range AS b, round(ln((coalesce(r, 0) + 1) / (coalesce(ra, 0) + {_SIZE})) - ln((coalesce(o, 0) + 1) / (coalesce(oa, 0) + {_SIZE})), 6) AS v
  FROM range({_SIZE}) x CROSS JOIN range({_SIZE}) y LEFT JOIN pairs p ON p.a = x.range AND p.b = y.range LEFT JOIN firsts f ON f.a = x.range),
base AS ({_sql_found("assign", ASSIGN, "length(v) >= 6", 2)} UNION ALL {_sql_found("access", ACCESS)} UNION ALL {_sql_found("hex", HEX)}),
found AS ({_sql_found("markov", CANDIDATE, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')")}),
scored AS (SELECT doc_id, k, s, e, avg(model.v) AS mean FROM (SELECT *, unnest(range(1, length(v))) AS i FROM found) f JOIN model ON model.a = instr('{ALPHABET}', f.v[i:i]) AND model.b = instr('{ALPHABET}', f.v[i + 1:i + 1]) GROUP BY doc_id, k, s, e),
more AS (SELECT doc_id, k, s, e FROM scored x WHERE mean >= {MARGIN} AND NOT EXISTS (SELECT 1 FROM base y WHERE y.doc_id = x.doc_id AND y.s < x.e AND x.s < y.e)),
named AS (SELECT doc_id, s, k, ['assign', 'access', 'hex', 'markov'][k + 1] || ':' || s || ':' || e AS n FROM (SELECT doc_id, k, s, e FROM base UNION ALL SELECT * FROM more)),
byd AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2, string_agg(n, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg(n, ',' ORDER BY s, k) AS spans FROM named GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN byd USING (doc_id)
"""
