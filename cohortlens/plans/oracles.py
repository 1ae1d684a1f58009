"""SQL for another engine that gives the rows of the registered queries from the same tables."""

from __future__ import annotations

from cohortlens.functions import prompts as P
from cohortlens.functions.hashing import MIXERS
from cohortlens.functions.labels import LABELS, UNCERTAIN_POLICY
from cohortlens.operators.audits import LABEL_SOURCE
from cohortlens.operators.inference import ADDED, CONTRASTS, LESS_IS_BETTER
from cohortlens.operators.metrics import NAMES, TOTALS
from cohortlens.operators.revision import ARMS, CONDITIONS
from cohortlens.operators.transitions import JOINT_COUNTS
from cohortlens.plans.fixtures import MEANS
from cohortlens.plans.queries import REPLICATES, SUMS

N, SEED, SIZE = REPLICATES, 20260831, len(LABELS)
LIST = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"


def draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def mixed(x: str) -> str:
    """A step of the draws of resampling; `x` is an expression for an integer in [0, 2**32)."""
    for shift, factor in ((16, MIXERS[0]), (15, MIXERS[1])):
        x = f"((xor({x}, {x} >> {shift}) * {factor}) & 4294967295)"
    return f"xor({x}, {x} >> 15)"


def _mixed(x: int) -> int:
    for shift, factor in ((16, MIXERS[0]), (15, MIXERS[1])):
        x = (x ^ x >> shift) * factor & 0xFFFFFFFF
    return x ^ x >> 15


#: The replicates with the state of their draws; drawn() goes on from it with an integer.
REPLICATE = f"(SELECT b, {mixed(f'(({_mixed(SEED)} + b) & 4294967295)')} AS hb FROM range({N}) r(b))"


def drawn(part: str) -> str:
    return mixed(f"((hb + {part}) & 4294967295)")


def ratio(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def normal(text: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9]+', ' ', 'g'))"


def clean(text: str) -> str:
    return f"trim(regexp_replace(coalesce({text}, ''), '\\s+', ' ', 'g'))"


def text_hash(text: str) -> str:
    return f"sha256(nullif({normal(text)}, ''))"


def bits(values: str) -> str:
    return f"array_to_string({values}, '')"


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


KNOWN = f"list_filter({LIST}, lambda x, i: {draw('chr(114)', 'doc_id', 'i - 1')} % 100 < 25)".replace("chr(114)", "'r'")
CUES = "['No evidence of ', 'Free of ', 'There is ', 'Not one two three four five six seven eight ']"
FINDINGS = f"array_to_string(list_transform(list_filter(range(0, {SIZE}), lambda i: {draw(chr(39) + 'r' + chr(39), 'doc_id', 'i')} % 100 < 25), lambda i: {CUES}[{draw(chr(39) + 'c' + chr(39), 'doc_id', 'i')} % 4 + 1] || {LIST}[i + 1]), '. And then, after all of this was seen again and once more today: ')"
NEGATES = r"\b(?:no|not|without|absent|negative\s+for|free\s+of|no\s+evidence\s+of)\b"


def flags(text: str, labels: str) -> str:
    pieces = f"string_split_regex({text}, '\\b' || l || '\\b')"
    before = f"trim(right(list_reduce(({pieces})[1:k], lambda a, b: a || l || b), 80))"
    return f"list_sort(list_filter({labels}, lambda l: len(list_filter(range(1, len({pieces})), lambda k: regexp_matches(array_to_string((string_split_regex({before}, ' +'))[-8:], ' '), '{NEGATES}'))) > 0))"


MANIFEST = f"""
m0 AS (SELECT *, {draw("'n'", 'doc_id // 4')} % 10 = 0 AS near, CASE WHEN lang = 'en' THEN 'alpha' ELSE 'beta' END AS dataset,
  CASE WHEN {draw("'pm'", 'doc_id')} % 50 = 0 THEN NULL ELSE 'p' || ({draw("'p'", 'doc_id')} % 5000) END AS patient_id FROM documents),
m1 AS (SELECT *, CASE WHEN near THEN md5(concat_ws('|', 'b', doc_id // 4)) ELSE md5(concat_ws('|', 'u', doc_id)) END AS base FROM m0),
m AS (SELECT doc_id, printf('%s:%08d', dataset, doc_id) AS record_id, dataset, source, patient_id, dataset || ':' || patient_id AS patient_key,
  patient_id IS NOT NULL AND {draw("'rel'", 'doc_id')} % 3 <> 0 AS patient_reliable, 's' || ({draw("'s'", 'doc_id')} % 4000) AS study_id, 'i' || doc_id AS image_id,
  CASE WHEN {draw("'im'", 'doc_id')} % 20 = 0 THEN NULL ELSE sha256('img' || ({draw("'i'", 'doc_id')} % 20000)) END AS image_sha256, {text_hash('text')} AS report_sha256,
  ('0x' || substr(base, 1, 8))::BIGINT AS hi, xor(('0x' || substr(base, 9, 8))::BIGINT, CASE WHEN near THEN 1::BIGINT << (doc_id % 4 * 3)::INT ELSE 0 END) AS lo,
  {KNOWN} AS labels, {flags(normal(FINDINGS), KNOWN)} AS negated_flags FROM m1),
g AS (SELECT * FROM m WHERE doc_id % 5 <> 0), q AS (SELECT * FROM m WHERE doc_id % 5 = 0),
nearg AS (SELECT DISTINCT g.record_id FROM g JOIN q ON bit_count(xor(g.hi, q.hi)) + bit_count(xor(g.lo, q.lo)) <= 4)"""
_REASONS = [f"CASE WHEN {f} IN (SELECT {f} FROM q WHERE {f} IS NOT NULL) THEN '{f}_overlap' END" for f in ("study_id", "image_id", "image_sha256", "report_sha256")]
_REASONS.append("CASE WHEN patient_reliable AND patient_key IN (SELECT patient_key FROM q WHERE patient_reliable) THEN 'reliable_patient_overlap' WHEN patient_key IN (SELECT patient_key FROM q WHERE patient_key IS NOT NULL) THEN 'assumed_patient_group_overlap' END")
_REASONS.append("CASE WHEN record_id IN (SELECT record_id FROM nearg) THEN 'image_phash_distance<=4' END")
CLEANED = MANIFEST + f""",
c AS (SELECT *, list_sort(list_filter([{', '.join(_REASONS)}], lambda x: x IS NOT NULL)) AS reasons FROM g)"""

GRID = ", ".join(f"('{m}', '{c}', {f})" for m in ("m1", "m2", "m3") for c, f in (("A", 20), ("B", 17), ("C", 15), ("D", 10)))
VECTORS = f"""
v0 AS (SELECT doc_id, source AS cluster, lang, list_transform(range(0, {SIZE}), lambda i: ({draw("'r'", 'doc_id', 'i')} % 100 < 25)::INT) AS reference FROM documents),
grid AS (SELECT * FROM (VALUES {GRID}) t(model, condition, flip)),
v AS (SELECT v0.*, model, condition, list_transform(range(0, {SIZE}), lambda i: xor(reference[i + 1], ({draw("'p'", 'model', 'condition', 'doc_id', 'i')} % 100 < flip)::INT)) AS prediction FROM v0, grid)"""


def wrong(a: str, b: str = "reference") -> str:
    return "(" + " + ".join(f"({a}[{i}] <> {b}[{i}])::INT" for i in range(1, SIZE + 1)) + ")"


def listed(v: str) -> str:
    return "(" + " + ".join(f"{v}[{i}]" for i in range(1, SIZE + 1)) + ")"


_SCORE = lambda seed: draw(f"'{seed}'", "model", "condition", "doc_id")
SCORED = f"""
vs AS (SELECT *, CASE WHEN {_SCORE('ov')} % 10 > 0 THEN {_SCORE('ov')} % 1024 / 1024.0::DOUBLE END AS overlap,
  CASE WHEN {draw("'sc'", 'cluster')} % 3 = 0 THEN CASE {_SCORE('sx')} % 9 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE ELSE {_SCORE('sx')} % 1024 / 1024.0::DOUBLE END END AS similarity FROM v)"""


def kind(total: str) -> str:
    return "DOUBLE" if "sum_" in total else "BIGINT"


def totals(groups: str, source: str = "v", means=()) -> str:
    r, p = "reference", "prediction"
    sums = [f"sum({r}[{i}] * {p}[{i}])::BIGINT AS tp_{i - 1}" for i in range(1, SIZE + 1)]
    sums += [f"sum((1 - {r}[{i}]) * {p}[{i}])::BIGINT AS fp_{i - 1}" for i in range(1, SIZE + 1)]
    sums += [f"sum({r}[{i}] * (1 - {p}[{i}]))::BIGINT AS fn_{i - 1}" for i in range(1, SIZE + 1)]
    false = " + ".join(f"(1 - {r}[{i}]) * {p}[{i}]" for i in range(1, SIZE + 1))
    sums += [
        "count(*)::BIGINT AS n_records", f"sum({SIZE} - {wrong(p)})::BIGINT AS matching_labels", f"sum((({listed(r)} = 0) = ({listed(p)} = 0))::INT)::BIGINT AS normal_abnormal_correct",
        f"sum(({listed(r)} > 0)::INT * ({false}))::BIGINT AS fp_abnormal", f"sum(({listed(r)} > 0)::INT * {listed(p)})::BIGINT AS predicted_positive_abnormal",
    ]
    sums += [x for c in means for x in (f"coalesce(sum({c}) FILTER (isfinite({c})), 0)::DOUBLE AS sum_{c}", f"count(*) FILTER (isfinite({c})) AS finite_{c}")]
    return f"SELECT {groups}, {', '.join(sums)} FROM {source} GROUP BY {groups}"


def metrics(of=lambda c: c, means=()) -> dict[str, str]:
    tp, fp, fn = ([of(f"{k}_{i}") for i in range(SIZE)] for k in ("tp", "fp", "fn"))
    add = lambda xs: "(" + " + ".join(xs) + ")"
    f1 = [ratio(f"2 * {t}", f"2 * {t} + {p} + {n}") for t, p, n in zip(tp, fp, fn, strict=True)]
    defined = add([f"({x} IS NOT NULL)::INT" for x in f1])
    return {
        "fer": ratio(add(fp), f"{add(tp)} + {add(fp)}"), "fer_abnormal": ratio(of("fp_abnormal"), of("predicted_positive_abnormal")), "omission": ratio(add(fn), f"{add(tp)} + {add(fn)}"),
        "macro_f1": f"({add([f'coalesce({x}, 0)' for x in f1])} / nullif({defined}, 0))", "micro_f1": ratio(f"2 * {add(tp)}", f"2 * {add(tp)} + {add(fp)} + {add(fn)}"),
        "hamming_accuracy": ratio(of("matching_labels"), f"{of('n_records')} * {SIZE}"), "normal_abnormal_accuracy": ratio(of("normal_abnormal_correct"), of("n_records")),
        "false_positive_events": f"{add(fp)}::DOUBLE", "predicted_positive_events": f"({add(tp)} + {add(fp)})::DOUBLE",
        "false_negative_events": f"{add(fn)}::DOUBLE", "reference_positive_events": f"({add(tp)} + {add(fn)})::DOUBLE",
    } | {f"f1_{n}": x for n, x in zip(NAMES, f1, strict=True)} | {c: ratio(of(f"sum_{c}"), of(f"finite_{c}")) for c in means}


def every(of=lambda c: c) -> dict[str, str]:
    return metrics(of, MEANS)


def grouped(groups: str, source: str = "v", means=()) -> str:
    defined = " + ".join(f"(2 * tp_{i} + fp_{i} + fn_{i} > 0)::INT" for i in range(SIZE))
    return f"SELECT {groups}, n_records, ({defined}) AS n_defined_labels, {', '.join(f'round({x}, 6) AS {k}' for k, x in metrics(means=means).items())} FROM ({totals(groups, source, means)})"


def long(select: str, values: dict[str, str], source: str, value: str = "value") -> str:
    keys = ", ".join(f"'{k}'" for k in values)
    return f"SELECT {select}, unnest([{keys}]) AS metric, unnest([{', '.join(f'({x})::DOUBLE' for x in values.values())}]) AS {value} FROM {source}"


def differences(values) -> dict[str, str]:
    a, b = values(lambda c: f"a_{c}"), values(lambda c: f"b_{c}")
    return {k: f"{b[k]} - {a[k]}" for k in a}


def bootstrap(stats: str, strata: str, sums: list[str], values: dict[str, str]) -> str:
    """CTEs that end in the result, from the relation `stats`."""
    total = ", ".join(f"sum({c})::{kind(c)} AS {c}" for c in sums)
    weighted = ", ".join(f"sum({c} * w)::{kind(c)} AS {c}" for c in sums)
    using = ", ".join(strata.split(", "))
    return f"""
nb AS (SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY {draw('cluster')} >> 22, cluster) - 1 AS i, count(*) OVER (PARTITION BY {strata}) AS n FROM {stats}),
slots AS (SELECT n, b, hb, unnest(range(n)) AS slot FROM (SELECT DISTINCT n FROM nb), {REPLICATE}),
w AS (SELECT n, b, {drawn('slot')} % n AS i, count(*) AS w FROM slots GROUP BY ALL),
drawn AS (SELECT {strata}, b, {weighted} FROM nb JOIN w USING (n, i) GROUP BY {strata}, b),
point AS (SELECT {strata}, {total} FROM {stats} GROUP BY {strata}),
pl AS ({long(strata, values, 'point')}), dl AS ({long(strata, values, 'drawn')}),
ci AS (SELECT {strata}, metric, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, count(value) AS n_valid FROM dl GROUP BY {strata}, metric)
SELECT {strata}, metric, round(value, 6) + 0.0 AS estimate, round(lo, 6) + 0.0 AS ci_low, round(hi, 6) + 0.0 AS ci_high, n_valid FROM pl JOIN ci USING ({using}, metric)"""


def arms(name: str, a: str, b: str, source: str = "cs") -> str:
    side = ", ".join(f"max({c}) FILTER (condition = '{x}') AS {t}_{c}" for t, x in (("a", a), ("b", b)) for c in SUMS)
    return f"{name} AS (SELECT model, cluster, {side} FROM {source} WHERE condition IN ('{a}', '{b}') GROUP BY model, cluster)"


def permutation(name: str, source: str, by: str = "model", values=every, sums=SUMS) -> str:
    """CTEs; `name` has (by, metric, difference, p_value, valid)."""
    both = ", ".join(f"sum({t}_{c})::{kind(c)} AS {t}_{c}" for t in "ab" for c in sums)
    swapped = ", ".join(f"sum(CASE WHEN swap THEN {o}_{c} ELSE {t}_{c} END)::{kind(c)} AS {t}_{c}" for t, o in (("a", "b"), ("b", "a")) for c in sums)
    return f"""{name}_o AS ({long(by, differences(values), f'(SELECT {by}, {both} FROM {source} GROUP BY {by})', 'difference')}),
{name}_n AS ({long(f'{by}, b', differences(values), f"(SELECT {by}, b, {swapped} FROM (SELECT *, {drawn('h')} % 2 = 1 AS swap FROM (SELECT *, {draw('cluster')} AS h FROM {source}), {REPLICATE}) GROUP BY {by}, b)")}),
{name} AS (SELECT {by}, metric, difference, CASE WHEN difference IS NOT NULL THEN (coalesce(count(*) FILTER (abs(value) >= abs(difference) - 1e-15), 0) + 1) / (count(value) + 1) END AS p_value, count(value) AS valid
  FROM {name}_o JOIN {name}_n USING ({by}, metric) GROUP BY {by}, metric, difference)"""


JOINT = VECTORS + f""",
jv AS (SELECT model, lang, cluster, doc_id, any_value(reference) AS reference, max(prediction) FILTER (condition = 'B') AS b, max(prediction) FILTER (condition = 'C') AS c, max(prediction) FILTER (condition = 'D') AS d FROM v GROUP BY model, lang, cluster, doc_id),
je AS (SELECT *, {wrong('b')} AS eb, {wrong('c')} AS ec, {wrong('d')} AS ed FROM jv),
j AS (SELECT model, lang, cluster, doc_id, reference, b, c, d,
  {' + '.join(f'(b[{i}] <> reference[{i}] AND c[{i}] <> reference[{i}] AND d[{i}] = reference[{i}])::INT' for i in range(1, SIZE + 1))} AS event_rescue,
  {' + '.join(f'(b[{i}] = reference[{i}] AND c[{i}] = reference[{i}] AND d[{i}] <> reference[{i}])::INT' for i in range(1, SIZE + 1))} AS event_harm,
  {' + '.join(f'(b[{i}] <> reference[{i}] AND c[{i}] <> reference[{i}])::INT' for i in range(1, SIZE + 1))} AS wrong_events,
  {' + '.join(f'(b[{i}] = reference[{i}] AND c[{i}] = reference[{i}])::INT' for i in range(1, SIZE + 1))} AS correct_events, {SIZE} AS events,
  (eb > 0 AND ec > 0 AND ed = 0)::INT AS strict_rescue, (eb = 0 AND ec = 0 AND ed > 0)::INT AS strict_harm, (eb > 0 AND ec > 0)::INT AS wrong_studies, (eb = 0 AND ec = 0)::INT AS correct_studies,
  (ed < least(eb, ec))::INT AS dominant_rescue, (ed > greatest(eb, ec))::INT AS dominant_harm, 1 AS n_records FROM je)"""
RATES = {
    "event_rescue_all": ratio("event_rescue", "events"), "event_harm_all": ratio("event_harm", "events"), "event_rescue_opportunity": ratio("event_rescue", "wrong_events"),
    "event_harm_opportunity": ratio("event_harm", "correct_events"), "event_net_all": ratio("event_rescue - event_harm", "events"), "strict_rescue_all": ratio("strict_rescue", "n_records"),
    "strict_harm_all": ratio("strict_harm", "n_records"), "strict_rescue_opportunity": ratio("strict_rescue", "wrong_studies"), "strict_harm_opportunity": ratio("strict_harm", "correct_studies"),
    "strict_net_all": ratio("strict_rescue - strict_harm", "n_records"), "dominant_rescue_all": ratio("dominant_rescue", "n_records"), "dominant_harm_all": ratio("dominant_harm", "n_records"),
}
JOINT_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in JOINT_COUNTS)
CLUSTERS = VECTORS + f", {SCORED}, cs AS ({totals('model, condition, cluster', 'vs', MEANS)})"
PAIRS = VECTORS + ", p AS (SELECT a.model, a.doc_id, a.lang, a.cluster, a.reference, a.prediction AS pa, b.prediction AS pb FROM v a JOIN v b USING (model, doc_id) WHERE a.condition = 'A' AND b.condition = 'D')"
PV = f"""pv AS (SELECT source, lang, CASE WHEN {draw("'pm'", 'source', 'lang')} % 10 > 0 THEN round(pow(({draw("'pv'", 'source', 'lang')} % 10000 + 1) / 10000.0::DOUBLE, 3), 6) END AS p_value FROM (SELECT DISTINCT source, lang FROM documents))"""


def holm(source: str, columns: str, family: str, order: str, missing: bool = False) -> str:
    q = "coalesce(p_value, 1)" if missing else "p_value"
    return f"""SELECT {columns}, p_value, CASE WHEN p_value IS NOT NULL THEN least(1.0, max((m - k + 1) * q) OVER (PARTITION BY {family} ORDER BY k ROWS UNBOUNDED PRECEDING)) END AS p_holm FROM (
SELECT *, {q} AS q, count({q}) OVER (PARTITION BY {family}) AS m, row_number() OVER (PARTITION BY {family} ORDER BY {q} ASC NULLS LAST, {order}) AS k FROM {source})"""


UNIT = "list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12))"
SIDES = f"e AS (SELECT vec_id, label, {UNIT} AS x FROM embeddings)"


def top_k(k: int, where: str = "true", source: str = "e", with_: str = SIDES) -> str:
    return f"""WITH {with_}, s AS (SELECT q.vec_id AS query_id, g.vec_id AS gallery_id, list_inner_product(q.x, g.x) AS score FROM {source} q JOIN {source} g ON {where} WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, gallery_id) AS rank, gallery_id, score FROM s QUALIFY rank <= {k}"""


DESCRIBED = f"{MANIFEST}, {SIDES}, ex AS (SELECT e.vec_id, e.x, m.* FROM e LEFT JOIN m ON e.vec_id = m.doc_id)"
RULES = {f"same_{f}": f"q.{f} = g.{f}" for f in ("record_id", "study_id", "image_id", "image_sha256", "report_sha256")} | {
    "same_patient_or_group": "CASE WHEN q.patient_key IS NOT NULL OR g.patient_key IS NOT NULL THEN q.patient_key = g.patient_key ELSE q.patient_id = g.patient_id END",
    "image_phash_distance<=4": "bit_count(xor(q.hi, g.hi)) + bit_count(xor(q.lo, g.lo)) <= 4",
}
SAFE = " AND ".join(f"NOT coalesce({r}, false)" for r in RULES.values())


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


HEX = "['TRUE', 'answer: false', 'Supported', '0', 'label = true', 'false, then true', 'untrue']"
LOG = VECTORS + f""", h AS (SELECT doc_id, model, condition, {draw("'log'", 'doc_id', 'model', 'condition')} % 50 AS h FROM v),
log AS (SELECT doc_id, model, condition FROM h WHERE h <> 0 UNION ALL SELECT doc_id, model, condition FROM h WHERE h = 1)"""
FORMS = VECTORS + ", f AS (SELECT a.doc_id, a.reference, a.prediction AS x, b.prediction AS y FROM v a JOIN v b USING (doc_id) WHERE a.model = 'm1' AND b.model = 'm1' AND a.condition = 'A' AND b.condition = 'D')"
KAPPA = "nullif(CASE WHEN abs(1 - ch) > 1e-12 THEN 1 - ch ELSE 0 END, 0)"
TAGS = "concat_ws(';', CASE WHEN strict_rescue = 1 THEN 'strict_rescue' END, CASE WHEN strict_harm = 1 THEN 'strict_harm' END, CASE WHEN dominant_rescue = 1 THEN 'dominant_rescue' END, CASE WHEN dominant_harm = 1 THEN 'dominant_harm' END)"
ROLES = "CASE role WHEN 'human' THEN 'user' WHEN 'prompt' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE role END"


def _grams(column: str) -> str:
    return f"SELECT doc_id, k, array_to_string({column}[i:i + k - 1], ' ') AS g, count(*) AS tf FROM w, (VALUES (1), (2), (3), (4)) t(k), LATERAL (SELECT unnest(range(1, len({column}) - k + 2)) AS i) GROUP BY ALL"


EVIDENCE = f"string_agg('REFERENCE ' || rank || ' (similarity=' || printf('%.6f', round(score, 3)) || '):' || chr(10) || trim({clean('text')}), chr(10) || chr(10) ORDER BY rank)"
ROOM = 1200 - len(P.RECOVERY)
PAYLOAD = ROOM - len(P.OMISSION)


def contrasts(pairs) -> str:
    """CTE `ar`: (contrast, model, cluster, a_*, b_*) of every contrast, from `cs`."""
    one = lambda a, b: f"SELECT '{a}-{b}' AS contrast, model, cluster, " + ", ".join(f"max({c}) FILTER (condition = '{x}') AS {t}_{c}" for t, x in (("a", a), ("b", b)) for c in SUMS) + f" FROM cs WHERE condition IN ('{a}', '{b}') GROUP BY model, cluster"
    return "ar AS (" + " UNION ALL ".join(one(a, b) for a, b in pairs) + ")"


def adjusted(source: str, p: str, out: str, family: str, order: str, missing: bool = False) -> str:
    """`source` with Holm's adjustment of the column `p`."""
    q = f"coalesce({p}, 1)" if missing else p
    work = f"(SELECT *, {q} AS q_, count({q}) OVER (PARTITION BY {family}) AS m_, row_number() OVER (PARTITION BY {family} ORDER BY {q} ASC NULLS LAST, {order}) AS k_ FROM {source})"
    return f"SELECT * EXCLUDE (q_, m_, k_), CASE WHEN {p} IS NOT NULL THEN least(1.0, max((m_ - k_ + 1) * q_) OVER (PARTITION BY {family} ORDER BY k_ ROWS UNBOUNDED PRECEDING)) END AS {out} FROM {work}"


BETTER = f"CASE WHEN metric IN ({', '.join(quoted(x) for x in LESS_IS_BETTER)}) THEN -difference ELSE difference END"
DIRECTION = f"CASE WHEN {BETTER} > 0 THEN 'better' WHEN {BETTER} < 0 THEN 'worse' WHEN {BETTER} = 0 THEN 'tie' END"
FIVE = f"""{CLUSTERS}, {contrasts((*CONTRASTS, ADDED))}, {permutation('pp', 'ar', 'contrast, model')}, h AS ({adjusted('pp', 'p_value', 'p_holm', 'model, metric', 'contrast')}),
ad AS (SELECT * FROM ar WHERE contrast = '{"-".join(ADDED)}'), iv AS (WITH {bootstrap('ad', 'contrast, model', [f'{t}_{c}' for t in 'ab' for c in SUMS], differences(every))}),
five AS (SELECT h.*, iv.ci_low, iv.ci_high, {DIRECTION} AS direction FROM h LEFT JOIN iv USING (contrast, model, metric))"""


def joint_summary(clusters: str, strata: str, family: str) -> str:
    """CTEs that end in `js`, from the relation `clusters`."""
    nets = {"event_net": "event_rescue - event_harm", "strict_net": "strict_rescue - strict_harm"}
    flips = ", ".join(f"sum(({x}) * f) AS {k}" for k, x in nets.items())
    total = ", ".join(f"sum({x}) AS {k}" for k, x in nets.items())
    p = ", ".join(f"(count(*) FILTER (abs(n.{k}) >= abs(o.{k})) + 1) / (count(*) + 1) AS {k}_p" for k in nets)
    return f"""bs AS (WITH {bootstrap(clusters, strata, list(JOINT_COUNTS), RATES)}), jn AS (SELECT {strata}, count(*) AS n_clusters, {JOINT_SUMS} FROM {clusters} GROUP BY {strata}),
fo AS (SELECT {strata}, {total} FROM {clusters} GROUP BY {strata}), fn AS (SELECT {strata}, b, {flips} FROM (SELECT *, {drawn('h')} % 2 * 2 - 1 AS f FROM (SELECT *, {draw('cluster')} AS h FROM {clusters}), {REPLICATE}) GROUP BY {strata}, b),
fp AS (SELECT {strata}, {p} FROM fn n JOIN fo o USING ({strata}) GROUP BY {strata}, o.event_net, o.strict_net),
f1 AS ({adjusted('fp', 'event_net_p', 'event_net_p_holm', family, strata)}), f2 AS ({adjusted('f1', 'strict_net_p', 'strict_net_p_holm', family, strata)}),
js AS (SELECT bs.*, jn.* EXCLUDE ({strata}), {r6('event_net_p', 'strict_net_p', 'event_net_p_holm', 'strict_net_p_holm')} FROM bs JOIN jn USING ({strata}) JOIN f2 USING ({strata}))"""


STRATEGY = VECTORS + ", " + SCORED + """, av AS (SELECT model, CASE WHEN condition IN ('A', 'C') THEN 'single' ELSE 'revised' END AS strategy, CASE WHEN condition IN ('A', 'B') THEN 'text' ELSE 'image' END AS arm, doc_id, cluster, reference, prediction, overlap, similarity FROM vs)"""
ARM_TOTALS = STRATEGY + f", ac AS ({totals('model, strategy, arm, cluster', 'av', MEANS)})"
ARM_PAIRS = STRATEGY + ", ap AS (SELECT a.model, a.strategy, a.doc_id, a.cluster, a.reference, a.prediction AS pa, b.prediction AS pb FROM av a JOIN av b USING (model, strategy, doc_id) WHERE a.arm = 'text' AND b.arm = 'image')"
CASES = f"SELECT model, strategy, doc_id, {wrong('pa')} AS errors_a, {wrong('pb')} AS errors_b, " + ", ".join(" + ".join(f"(pa[{i}] {x} reference[{i}] AND pb[{i}] {y} reference[{i}])::INT" for i in range(1, SIZE + 1)) + f" AS {n}" for n, x, y in (("errors_resolved", "<>", "="), ("errors_introduced", "=", "<>"))) + ", pa <> pb AS changed, errors_b < errors_a AS rescued, errors_b > errors_a AS harmed, errors_b = errors_a AS unchanged FROM ap"
GENERATIONS = f"""gl AS (SELECT doc_id, lang, model, condition, {KNOWN} AS known, model || '|' || CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END || '|' || doc_id || '|' || condition AS id, {draw(quoted('gen'), 'doc_id', 'model', 'condition')} % 200 AS h
  FROM documents, (VALUES ('m1'), ('m2'), ('m3')) a(model), (VALUES ('A'), ('B')) b(condition))"""
PEOPLE = VECTORS + f""", f AS (SELECT a.doc_id, a.reference, a.prediction AS x, d.prediction AS y, c.prediction AS p FROM v a JOIN v d USING (doc_id) JOIN v c USING (doc_id) WHERE a.model = 'm1' AND d.model = 'm1' AND c.model = 'm1' AND a.condition = 'A' AND d.condition = 'D' AND c.condition = 'C'),
fc AS (SELECT *, list_transform(range(1, {SIZE + 1}), lambda i: CASE WHEN x[i] = y[i] THEN x[i] ELSE reference[i] END) AS truth FROM f)"""


def validated(truth: str, name: str) -> str:
    """CTE of per-label counts and rates of the predictions `p` against `truth`, with the annotators' agreement."""
    rows = " UNION ALL ".join(f"""SELECT '{x}' AS label, count(*) FILTER ({truth}[{i}] = 1 AND p[{i}] = 1) AS tp, count(*) FILTER ({truth}[{i}] = 0 AND p[{i}] = 1) AS fp, count(*) FILTER ({truth}[{i}] = 1 AND p[{i}] = 0) AS fn, count(*) FILTER ({truth}[{i}] = 0 AND p[{i}] = 0) AS tn,
  count(*) AS n, sum(x[{i}] * y[{i}]) AS yes, sum(x[{i}]) AS a, sum(y[{i}]) AS b, sum((1 - x[{i}]) * (1 - y[{i}])) AS neither FROM fc""" for i, x in enumerate(LABELS, 1))
    return f"""{name} AS (SELECT *, {ratio('tp', 'tp + fn')} AS sensitivity, {ratio('tn', 'tn + fp')} AS specificity, {ratio('tp', 'tp + fp')} AS precision, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1, (yes + neither) / n AS agreement,
  ((yes + neither) / n - ch) / {KAPPA} AS kappa FROM (SELECT *, (a / n) * (b / n) + (1 - a / n) * (1 - b / n) AS ch FROM ({rows})))"""


def revision_passes() -> str:
    """CTEs s0 to s4 of the deterministic models' runs: prompts and reports by their lengths."""
    report = lambda n: f"CASE WHEN {n} % 11 = 6 THEN '' WHEN {n} % 11 = 0 THEN 'report ' || ({n} + 5) ELSE 'report ' || {n} END"
    gate = ", ".join(quoted(c) for c in CONDITIONS[2:])
    out = [f"""s0 AS (SELECT doc_id, condition, ev, {report('(ev + 16)')} AS r, 1 AS n_reports, 0 AS n_verdicts, ((ev + 16) % 11 IN (0, 6))::INT AS n_recovered,
  CASE WHEN (ev + 16) % 11 = 6 THEN 'empty_initial_after_recovery' WHEN condition = '{CONDITIONS[0]}' THEN 'single_pass' END AS stop
  FROM (SELECT doc_id, length({clean('text')}) AS ev FROM documents), (VALUES {', '.join(f"('{c}')" for c in CONDITIONS)}) t(condition))"""]
    for k in range(1, 5):
        out.append(f"""g{k} AS (SELECT *, stop IS NULL AND condition IN ({gate}) AS judged, stop IS NULL AND condition IN ({gate}) AND (length(r) + ev + CASE WHEN condition = '{CONDITIONS[3]}' THEN 2 ELSE 0 END) % 3 = 0 AS accepted, 16 + length(r) + ev AS n FROM s{k - 1}),
s{k} AS (SELECT doc_id, condition, ev, CASE WHEN stop IS NULL AND NOT accepted AND n % 11 <> 6 THEN {report('n')} ELSE r END AS r, n_reports + (stop IS NULL AND NOT accepted)::INT AS n_reports, n_verdicts + judged::INT AS n_verdicts,
  n_recovered + (stop IS NULL AND NOT accepted AND n % 11 IN (0, 6))::INT AS n_recovered, CASE WHEN stop IS NOT NULL THEN stop WHEN accepted THEN 'verifier_true' WHEN n % 11 = 6 THEN 'empty_revision_fallback' {"WHEN true THEN 'max_passes'" if k == 4 else ''} END AS stop FROM g{k})""")
    return ", ".join(out)


def matched_passes() -> str:
    gate = ", ".join(quoted(c) for c in CONDITIONS[2:])
    report = lambda n: f"'report ' || {n} || CASE WHEN arm = '{ARMS[1]}' THEN '+' ELSE '' END"
    out = [f"""s0 AS (SELECT condition, arm, ev, {report('(ev + 16)')} AS r, 1 AS n_reports, (ev + 16) % 13 = 0 AS failed, CASE WHEN condition = '{CONDITIONS[0]}' THEN 'single_pass' END AS stop
  FROM (SELECT length({clean('text')}) AS ev FROM documents), (VALUES {', '.join(f"('{c}')" for c in CONDITIONS)}) t(condition), (VALUES {', '.join(f"('{a}')" for a in ARMS)}) u(arm))"""]
    for k in range(1, 5):
        out.append(f"""g{k} AS (SELECT *, NOT failed AND stop IS NULL AND condition IN ({gate}) AS judged, 16 + length(r) + ev AS n FROM s{k - 1}), w{k} AS (SELECT *, judged AND length(r) % 11 = 10 AS unread, judged AND length(r) % 11 <> 10 AND (length(r) + ev) % 3 = 0 AS accepted FROM g{k}),
s{k} AS (SELECT condition, arm, ev, CASE WHEN stop IS NULL AND NOT accepted THEN {report('n')} ELSE r END AS r, n_reports + (stop IS NULL AND NOT accepted)::INT AS n_reports, failed OR unread OR (stop IS NULL AND NOT accepted AND n % 13 = 0) AS failed,
  CASE WHEN stop IS NOT NULL THEN stop WHEN accepted THEN 'verifier_true' {"WHEN true THEN 'max_passes'" if k == 4 else ''} END AS stop FROM w{k})""")
    return ", ".join(out)


ORACLES: dict[str, str] = {
    "norm_text_hash": f"SELECT doc_id, length({normal('text')}) AS n_normal, {text_hash('text')} AS report_hash, sha256(text) AS raw_hash FROM documents",
    "label_vector": f"SELECT doc_id, array_to_string({KNOWN}, ',') AS known, {bits(f'list_transform({LIST}, lambda x: list_contains({KNOWN}, x)::INT)')} AS vector FROM documents",
    "negation_flags": f"SELECT doc_id, array_to_string({flags(normal(FINDINGS), KNOWN)}, ',') AS flags FROM documents",
    "state_mapping": "SELECT doc_id, concat(" + ", ".join(f"CASE {draw(chr(39) + 'st' + chr(39), 'doc_id', str(i))} % 4 WHEN 0 THEN 1 WHEN 2 THEN {UNCERTAIN_POLICY[x]} ELSE 0 END" for i, x in enumerate(LABELS)) + ") AS vector FROM documents",
    "chat_normalize": "WITH m AS (SELECT conv_id, turn, role, trim(coalesce(text, '')) AS t FROM conversations WHERE trim(coalesce(text, '')) <> '' AND role <> '') SELECT conv_id, coalesce(count(t), 0) AS n, count(*) FILTER (role = 'user' AND t IS NOT NULL) AS n_user, count(*) FILTER (role = 'assistant' AND t IS NOT NULL) AS n_assistant, md5(arg_max(t, turn) FILTER (role = 'assistant')) AS last_answer FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN m USING (conv_id) GROUP BY conv_id",
    "verdict_words": f"SELECT doc_id, [true, false, true, false, true, NULL, NULL][k] AS target, [true, false, NULL, NULL, true, false, NULL][k] AS verdict FROM (SELECT doc_id, {draw(chr(39) + 'v' + chr(39), 'doc_id')} % 7 + 1 AS k FROM documents)",
    "stable_key": f"SELECT doc_id, CASE k WHEN 0 THEN 'record_id:r' || doc_id WHEN 1 THEN 'image_path:/x/' || doc_id ELSE 'study_id:' || source END AS key FROM (SELECT *, {draw(chr(39) + 'k' + chr(39), 'doc_id')} % 3 AS k FROM documents)",
    "safe_topk_retrieval": f"SELECT query_id, rank, gallery_id, round(score, 6) AS score FROM ({top_k(10, SAFE, 'ex', DESCRIBED)})",
    "raw_topk": f"SELECT query_id, rank, gallery_id, round(score, 6) AS score FROM ({top_k(10, 'true')})",
    "rank1_review": f"SELECT query_id, rank, gallery_id, round(score, 6) AS score FROM ({top_k(1, 'true')}) WHERE score >= 0.9999",
    "evidence_prompt": f"""SELECT query_id, count(*) AS n_neighbors, sha256({EVIDENCE}) AS prompt_hash
FROM ({top_k(10, SAFE, 'ex', DESCRIBED)}) t LEFT JOIN documents d ON d.doc_id = t.gallery_id GROUP BY query_id""",
    "retrieval_bundles": f"""WITH {DESCRIBED}, s AS (SELECT b || '|' || q.vec_id AS query_id, g.vec_id AS gallery_id, list_inner_product(q.x, g.x) AS score
  FROM ex q JOIN (VALUES ('even'), ('odd'), ('all')) t(b) ON true JOIN ex g ON (b = 'all' OR (b = 'even') = (g.vec_id % 2 = 0)) AND {SAFE} WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, gallery_id) AS rank, gallery_id, round(score, 6) AS score FROM s) SELECT * FROM r WHERE rank <= 5""",
    "neighbor_audit": f"""WITH {DESCRIBED}, t AS ({top_k(10)}), x AS (SELECT t.query_id, unnest([{', '.join(f"CASE WHEN {r} THEN '{k}' END" for k, r in RULES.items())}, '']) AS reason FROM t JOIN ex q ON q.vec_id = t.query_id JOIN ex g ON g.vec_id = t.gallery_id)
SELECT query_id, count(*) FILTER (reason = '') AS n_neighbors, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason) FILTER (reason <> ''), '') AS reasons FROM x GROUP BY query_id HAVING n_neighbors <> 10 OR reasons <> ''""",
    "neighbor_content": f"WITH {MANIFEST} SELECT record_id, CASE WHEN doc_id % 50 = 0 THEN 'record_id' ELSE 'study_id' END AS differing FROM m WHERE doc_id % 3 = 0 AND (doc_id % 50 = 0 OR {draw(quoted('nc'), 'doc_id')} % 10 = 0)",
    "prompts": f"""WITH x AS (SELECT doc_id, {clean('text')} AS t, source AS r, doc_id % 4 + 1 AS k FROM documents), y AS (SELECT *, {quoted(P.FIRST)} || t || {quoted(P.FIRST_END)} AS p FROM x)
SELECT doc_id, md5(p) AS first, md5({quoted(P.FIRST_NEUTRAL)} || t || {quoted(P.FIRST_END)}) AS first_neutral,
  {', '.join(f"md5({quoted(P.PASS)} || k || {quoted(v + P.CANDIDATE)} || r || chr(10) || chr(10) || t || {quoted(P.REVISION_END)}) AS {n}" for n, v in (('revision', P.REVISION), ('revision_neutral', P.REVISION_NEUTRAL)))},
  md5({quoted(P.VERIFIER)} || CASE WHEN doc_id % 2 = 0 THEN {quoted(P.EVIDENCE)} || t || chr(10) || chr(10) || {quoted(P.STATEMENT)} || r ELSE {quoted(P.STATEMENT)} || r END || {quoted(P.VERIFIER_END)}) AS verifier,
  md5(CASE WHEN length(p) > {ROOM} THEN substr(p, 1, {PAYLOAD // 3}) || {quoted(P.OMISSION)} || right(p, {PAYLOAD - PAYLOAD // 3}) ELSE p END || {quoted(P.RECOVERY)}) AS recovery FROM y""",
    "overlap_audit_counts": f"WITH {MANIFEST}, o AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, k FROM (SELECT {f} AS k FROM g WHERE {f} IS NOT NULL{w} INTERSECT SELECT {f} FROM q WHERE true{w})" for f, w in (("study_id", ""), ("image_id", ""), ("image_sha256", ""), ("report_sha256", ""), ("patient_key", " AND patient_reliable"))) + " UNION ALL SELECT 'image_phash', record_id FROM nearg) SELECT f.field, count(k) AS n_overlap, coalesce(array_to_string(list_sort(list(k) FILTER (k IS NOT NULL))[1:20], ','), '') AS examples FROM (VALUES ('study_id'), ('image_id'), ('image_sha256'), ('report_sha256'), ('patient_key'), ('image_phash')) f(field) LEFT JOIN o USING (field) GROUP BY f.field",
    "gallery_clean": f"WITH {CLEANED} SELECT record_id, report_sha256 FROM c WHERE len(reasons) = 0",
    "gallery_removed": f"WITH {CLEANED} SELECT record_id, array_to_string(reasons, ',') AS reasons FROM c WHERE len(reasons) > 0",
    "removal_reason_counts": f"WITH {CLEANED} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM c) GROUP BY reason",
    "near_hash_pairs": f"WITH {MANIFEST} SELECT a.doc_id AS id_a, b.doc_id AS id_b, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::INT AS distance FROM m a JOIN m b ON a.doc_id < b.doc_id AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 4",
    "cohort_summary": f"WITH {MANIFEST} SELECT count(*) AS n_images, count(DISTINCT image_id) AS n_unique_image_ids, count(DISTINCT study_id) AS n_unique_studies, count(DISTINCT patient_id) AS n_patients_or_groups, count(DISTINCT patient_id) FILTER (patient_reliable) AS n_unique_reliable_patients, count(*) FILTER (patient_id IS NULL) AS n_missing_patient_id, count(*) FILTER (patient_reliable) AS n_reliable, count(*) FILTER (len(labels) = 0) AS n_normal, count(*) FILTER (len(labels) > 0) AS n_abnormal, count(*) FILTER (len(negated_flags) > 0) AS n_label_quality_flags, (SELECT string_agg(l || '=' || n, ',' ORDER BY l) FROM (SELECT l, count(*) AS n FROM (SELECT unnest(labels) AS l FROM m) GROUP BY l)) AS label_counts FROM m",
    "eval_overlap": f"""WITH {MANIFEST}, t AS (SELECT record_id, coalesce(patient_id, study_id) AS grp, patient_id, study_id AS src, report_sha256 FROM g),
ek AS (SELECT patient_key AS k FROM q UNION SELECT patient_id FROM q UNION SELECT regexp_extract(patient_key, '^[^:]*:(.+)$', 1) FROM q WHERE patient_key IS NOT NULL), es AS (SELECT record_id AS k FROM q UNION SELECT study_id FROM q UNION SELECT image_id FROM q),
x AS (SELECT record_id, list_filter([CASE WHEN grp IN (SELECT k FROM ek WHERE k IS NOT NULL) OR patient_id IN (SELECT k FROM ek WHERE k IS NOT NULL) THEN 'evaluation_patient_or_group' END, CASE WHEN src IN (SELECT k FROM es) THEN 'evaluation_source_id' END, CASE WHEN report_sha256 IN (SELECT report_sha256 FROM q WHERE report_sha256 IS NOT NULL) THEN 'evaluation_report_hash' END], lambda r: r IS NOT NULL) AS r FROM t)
SELECT record_id, array_to_string(r, ',') AS reasons FROM x WHERE len(r) > 0""",
    "align_unique": "SELECT 'r' || doc_id AS record_id, doc_id AS vector_id FROM documents",
    "combined_gallery": f"WITH {CLEANED} SELECT dataset, count(*) AS n, count(DISTINCT study_id) AS n_studies FROM c WHERE len(reasons) = 0 GROUP BY dataset",
    "label_metrics_by_group": f"WITH {VECTORS}, {SCORED} {grouped('model, condition', 'vs', MEANS)}",
    "per_label_confusion": f"WITH {VECTORS}, t AS ({totals('model')}), x AS (" + " UNION ALL ".join(f"SELECT model, '{x}' AS label, tp_{i} AS tp, fp_{i} AS fp, fn_{i} AS fn, n_records - tp_{i} - fp_{i} - fn_{i} AS tn FROM t" for i, x in enumerate(LABELS)) + f") SELECT *, round({ratio('tp', 'tp + fn')}, 6) AS sensitivity, round({ratio('tn', 'tn + fp')}, 6) AS specificity, round({ratio('tp', 'tp + fp')}, 6) AS precision, round({ratio('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM x",
    "verifier_confusion": f"""WITH x AS (SELECT lang, quality = 1 AS t, CASE WHEN {draw("'vm'", 'doc_id')} % 20 > 0 THEN ({draw("'v'", 'doc_id')} % 10 < 8) = (quality = 1) END AS p FROM labels JOIN documents USING (doc_id)),
y AS (SELECT lang, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (t IS NULL OR p IS NULL) AS n_missing FROM x GROUP BY lang)
SELECT *, round({ratio('tp + tn', 'tp + fp + fn + tn')}, 6) AS accuracy, round({ratio('tp', 'tp + fn')}, 6) AS sensitivity, round({ratio('tn', 'tn + fp')}, 6) AS specificity, round({ratio('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM y""",
    "runtime_summary": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY event_type",
    "timing_quantiles": "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "cohort_composition": f"WITH {MANIFEST} SELECT dataset, count(*) AS n, count(*) FILTER (len(labels) = 0) AS n_normal, " + ", ".join(f"count(*) FILTER (list_contains(labels, '{x}')) AS n_{x.replace(' ', '_')}" for x in LABELS) + " FROM m GROUP BY dataset",
    "paired_arms": f"WITH {PAIRS} SELECT model, cluster, count(*) AS n, sum({wrong('pa')})::BIGINT AS errors_a, sum({wrong('pb')})::BIGINT AS errors_b FROM p GROUP BY model, cluster",
    "error_transitions": f"WITH {VECTORS}, x AS (SELECT *, {wrong('prediction')} AS e FROM v), y AS (SELECT *, max(e) FILTER (condition = 'A') OVER (PARTITION BY model, lang, doc_id) AS e0 FROM x) SELECT model, lang, condition, count(*) FILTER (e < e0) AS rescued, count(*) FILTER (e > e0) AS harmed, count(*) FILTER (e = e0) AS unchanged FROM y GROUP BY model, lang, condition",
    "resolved_introduced": f"WITH {PAIRS}, x AS (SELECT *, {wrong('pa')} AS ea, {wrong('pb')} AS eb FROM p) SELECT model, lang, count(*) AS n_pairs, count(*) FILTER (eb < ea) AS rescued, count(*) FILTER (eb > ea) AS harmed, count(*) FILTER (eb = ea) AS unchanged, count(*) FILTER (pa <> pb) AS changed, "
    + ", ".join("sum(" + " + ".join(f"(pa[{i}] {a} reference[{i}] AND pb[{i}] {b} reference[{i}])::INT" for i in range(1, SIZE + 1)) + f")::BIGINT AS {n}" for n, a, b in (("errors_resolved", "<>", "="), ("errors_introduced", "=", "<>"))) + " FROM x GROUP BY model, lang",
    "ensemble_vote": f"WITH {VECTORS}, ev AS (SELECT doc_id, condition, any_value(reference) AS reference, [" + ", ".join(f"(sum(prediction[{i}]) * 2 > 3)::INT" for i in range(1, SIZE + 1)) + f"] AS prediction FROM v GROUP BY doc_id, condition HAVING count(DISTINCT model) = 3) {grouped('condition', 'ev')}",
    "best_single": f"WITH {VECTORS}, x AS (SELECT model, condition, {metrics()['macro_f1']} AS macro_f1 FROM ({totals('model, condition')})) SELECT condition, model, round(macro_f1, 6) AS macro_f1 FROM x QUALIFY row_number() OVER (PARTITION BY condition ORDER BY macro_f1 DESC NULLS LAST, model) = 1",
    "joint_rescue_counts": f"WITH {JOINT}, s AS (SELECT model, lang, {JOINT_SUMS} FROM j GROUP BY model, lang) SELECT *, " + ", ".join(f"round({x}, 6) AS {k}" for k, x in RATES.items()) + " FROM s",
    "joint_rescue_by_label": f"WITH {JOINT} " + " UNION ALL ".join(f"SELECT model, '{x}' AS label, count(*) FILTER (b[{i}] <> reference[{i}] AND c[{i}] <> reference[{i}] AND d[{i}] = reference[{i}]) AS rescue, count(*) FILTER (b[{i}] = reference[{i}] AND c[{i}] = reference[{i}] AND d[{i}] <> reference[{i}]) AS harm FROM j GROUP BY model" for i, x in enumerate(LABELS, 1)),
    "cluster_stats": f"WITH {CLUSTERS} SELECT * FROM cs",
    "cluster_bootstrap_ci": f"WITH {CLUSTERS}, {bootstrap('cs', 'model, condition', SUMS, every())}",
    "paired_bootstrap_diff": f"WITH {CLUSTERS}, {arms('ar', 'A', 'D')}, {bootstrap('ar', 'model', [f'{t}_{c}' for t in 'ab' for c in SUMS], differences(every))}",
    "paired_permutation_p": f"WITH {CLUSTERS}, {arms('ar', 'A', 'D')}, {permutation('pp', 'ar')} SELECT model, metric, round(difference, 6) + 0.0 AS difference, round(p_value, 6) AS p_value, valid FROM pp",
    "sign_flip_p": f"""WITH {JOINT}, s AS (SELECT model, cluster, sum(event_rescue - event_harm) AS event_net, sum(strict_rescue - strict_harm) AS strict_net FROM j GROUP BY model, cluster),
o AS ({long('model', {'event_net': 'event_net', 'strict_net': 'strict_net'}, '(SELECT model, sum(event_net) AS event_net, sum(strict_net) AS strict_net FROM s GROUP BY model)', 'net')}),
n AS ({long('model, b', {'event_net': 'event_net', 'strict_net': 'strict_net'}, f"(SELECT model, b, sum(event_net * f) AS event_net, sum(strict_net * f) AS strict_net FROM (SELECT *, {drawn('h')} % 2 * 2 - 1 AS f FROM (SELECT *, {draw('cluster')} AS h FROM s), {REPLICATE}) GROUP BY model, b)")})
SELECT model, metric, round(net, 6) + 0.0 AS net, round((count(*) FILTER (abs(value) >= abs(net)) + 1) / (count(*) + 1), 6) AS p_value FROM n JOIN o USING (model, metric) GROUP BY model, metric, net""",
    "joint_rates_ci": f"WITH {JOINT}, jc AS (SELECT model, cluster, {JOINT_SUMS} FROM j GROUP BY model, cluster), {bootstrap('jc', 'model', list(JOINT_COUNTS), RATES)}",
    "joint_label_ci": f"""WITH {JOINT}, lc AS (""" + " UNION ALL ".join(f"SELECT '{x}' AS label, cluster, count(*) FILTER (b[{i}] <> reference[{i}] AND c[{i}] <> reference[{i}] AND d[{i}] = reference[{i}]) AS rescue, count(*) FILTER (b[{i}] = reference[{i}] AND c[{i}] = reference[{i}] AND d[{i}] <> reference[{i}]) AS harm, count(*) AS n_records FROM j GROUP BY cluster" for i, x in enumerate(LABELS, 1))
    + f"""), sf AS (SELECT label, sum(rescue - harm) AS net FROM lc GROUP BY label), sn AS (SELECT label, b, sum((rescue - harm) * ({drawn('h')} % 2 * 2 - 1)) AS value FROM (SELECT *, {draw('cluster')} AS h FROM lc), {REPLICATE} GROUP BY label, b),
sp AS (SELECT label, 'labels' AS family, (count(*) FILTER (abs(value) >= abs(net)) + 1) / (count(*) + 1) AS p_value FROM sf JOIN sn USING (label) GROUP BY label, net), sh AS ({holm('sp', 'label', 'family', 'label')}),
bs AS (WITH {bootstrap('lc', 'label', ['rescue', 'harm', 'n_records'], {'rescue_rate': ratio('rescue', 'n_records'), 'harm_rate': ratio('harm', 'n_records'), 'net_rate': ratio('rescue - harm', 'n_records')})})
SELECT bs.*, {r6('p_value', 'p_holm')} FROM bs JOIN sh USING (label)""",
    "between_model_tests": f"WITH {CLUSTERS}, ab AS (SELECT x.model AS first, y.model AS second, x.cluster, " + ", ".join(f"x.{c} AS a_{c}, y.{c} AS b_{c}" for c in SUMS) + f" FROM cs x JOIN cs y ON x.cluster = y.cluster AND x.model < y.model AND x.condition = 'D' AND y.condition = 'D'), {permutation('pp', 'ab', 'first, second')}, h AS ({holm('pp', 'first, second, metric, difference, valid', 'metric', 'first, second')}) SELECT first, second, metric, round(difference, 6) + 0.0 AS difference, valid, {r6('p_value', 'p_holm')} FROM h",
    "verifier_records": f"""WITH x AS (SELECT doc_id, source, quality, {draw("'rec'", 'doc_id')} % 4 AS k FROM documents JOIN labels USING (doc_id)),
y AS (SELECT CASE WHEN k = 2 THEN 'source_report_or_image' ELSE 'patient' END AS grouping_level, ['label', 'ground_truth.answer', 'messages.assistant', 'verdict'][k + 1] AS verdict_source, quality = 1 AS verdict, CASE WHEN k < 2 THEN source WHEN k = 2 THEN 'f' || doc_id ELSE 'u' || doc_id END AS grp FROM x)
SELECT grouping_level, verdict_source, verdict, count(*) AS n, count(DISTINCT grp) AS n_groups FROM y GROUP BY ALL""",
    "pooled_joint": f"WITH {JOINT}, jc AS (SELECT 'all models' AS scope, cluster, {JOINT_SUMS} FROM j GROUP BY cluster), {bootstrap('jc', 'scope', list(JOINT_COUNTS), RATES)}",
    "holm_within": f"WITH {PV}, h AS ({holm('pv', 'source, lang', 'lang', 'source')}) SELECT source, lang, {r6('p_value', 'p_holm')} FROM h",
    "holm_between": f"WITH {CLUSTERS}, {contrasts(CONTRASTS)}, {permutation('pp', 'ar', 'contrast, model')}, h AS ({adjusted('pp', 'p_value', 'p_holm', 'metric', 'contrast, model')}) SELECT contrast, model, metric, {r6('p_value', 'p_holm')} FROM h",
    "within_model_tests": f"WITH {CLUSTERS}, {contrasts(CONTRASTS)}, {permutation('pp', 'ar', 'contrast, model')}, h AS ({adjusted('pp', 'p_value', 'p_holm', 'model, metric', 'contrast')}) SELECT contrast, model, metric, valid, round(difference, 6) + 0.0 AS difference, {r6('p_value', 'p_holm')} FROM h",
    "five_contrast_family": f"WITH {FIVE} SELECT contrast, model, metric, valid, round(difference, 6) + 0.0 AS difference, {r6('p_value', 'p_holm')}, ci_low, ci_high, direction FROM five",
    "added_contrast_summary": f"""WITH {FIVE} SELECT metric, count(*) AS n_strata, count(*) FILTER (p_holm < 0.05) AS n_significant, count(*) FILTER (p_holm < 0.05 AND direction = 'better') AS n_better, count(*) FILTER (p_holm < 0.05 AND direction = 'worse') AS n_worse,
  round(median(difference), 6) + 0.0 AS median_difference, round(min(difference), 6) + 0.0 AS min_difference, round(max(difference), 6) + 0.0 AS max_difference FROM five WHERE contrast = '{"-".join(ADDED)}' GROUP BY metric""",
    "ensemble_tests": f"WITH {CLUSTERS}, ev AS (SELECT doc_id, condition, cluster, any_value(reference) AS reference, [" + ", ".join(f"(sum(prediction[{i}]) * 2 > 3)::INT" for i in range(1, SIZE + 1)) + f"] AS prediction FROM v GROUP BY doc_id, condition, cluster HAVING count(DISTINCT model) = 3), ec AS ({totals('condition, cluster', 'ev')}), "
    + "ar AS (SELECT cs.condition, cs.model, cs.cluster, " + ", ".join([f"cs.{c} AS a_{c}" for c in TOTALS] + [f"ec.{c} AS b_{c}" for c in TOTALS]) + f" FROM cs JOIN ec USING (condition, cluster)), {permutation('pp', 'ar', 'condition, model', metrics, TOTALS)}, h AS ({adjusted('pp', 'p_value', 'p_holm', 'condition, metric', 'model')}), "
    + f"bm AS (SELECT model, condition, {metrics()['macro_f1']} AS macro_f1 FROM ({totals('model, condition')}) QUALIFY row_number() OVER (PARTITION BY condition ORDER BY macro_f1 DESC NULLS LAST, model) = 1) SELECT condition, model, metric, valid, round(difference, 6) + 0.0 AS difference, {r6('p_value', 'p_holm')}, bm.model IS NOT NULL AS is_best FROM h LEFT JOIN bm USING (condition, model)",
    "joint_stratum_summary": f"WITH {JOINT}, jc AS (SELECT model, lang, cluster, {JOINT_SUMS} FROM j GROUP BY model, lang, cluster), {joint_summary('jc', 'model, lang', 'true')} SELECT * FROM js",
    "pooled_joint_summary": f"WITH {JOINT}, jc AS (SELECT 'all models' AS scope, 0 AS fam, cluster, {JOINT_SUMS} FROM j GROUP BY cluster UNION ALL SELECT model, 1, cluster, {JOINT_SUMS} FROM j GROUP BY model, cluster), {joint_summary('jc', 'scope, fam', 'fam')} SELECT * EXCLUDE (fam, event_net_p_holm, strict_net_p_holm), CASE WHEN fam = 1 THEN event_net_p_holm END AS event_net_p_holm, CASE WHEN fam = 1 THEN strict_net_p_holm END AS strict_net_p_holm FROM js",
    "analysis_estimates": f"WITH {ARM_TOTALS}, bs AS (WITH {bootstrap('ac', 'model, strategy, arm', SUMS, every())}), w AS (SELECT model, strategy, arm, {', '.join(f'sum({c})::{kind(c)} AS {c}' for c in SUMS)} FROM ac GROUP BY ALL), d AS (SELECT model, strategy, arm, n_records, {' + '.join(f'(2 * tp_{i} + fp_{i} + fn_{i} > 0)::INT' for i in range(SIZE))} AS n_defined_labels, {metrics()['macro_f1']} AS f FROM w) "
    + f"SELECT bs.*, n_records, n_defined_labels, CASE WHEN n_defined_labels = {SIZE} THEN round(f, 6) END AS strict_macro_f1 FROM bs JOIN d USING (model, strategy, arm)",
    "analysis_effects": f"WITH {ARM_TOTALS}, ar AS (SELECT model, strategy, cluster, " + ", ".join(f"max({c}) FILTER (arm = '{x}') AS {t}_{c}" for t, x in (("a", "text"), ("b", "image")) for c in SUMS) + f" FROM ac GROUP BY model, strategy, cluster), {permutation('pp', 'ar', 'model, strategy')}, iv AS (WITH {bootstrap('ar', 'model, strategy', [f'{t}_{c}' for t in 'ab' for c in SUMS], differences(every))}), "
    + f"x AS (SELECT *, CASE WHEN strategy = 'single' THEN 'primary' ELSE 'secondary' END AS family FROM pp), h AS ({adjusted('x', 'p_value', 'p_holm', 'family, metric', 'model, strategy', True)}) SELECT model, strategy, metric, valid, family, round(difference, 6) + 0.0 AS difference, {r6('p_value', 'p_holm')}, round(100 * difference, 6) + 0.0 AS percentage_points, {DIRECTION} AS direction, ci_low, ci_high, n_valid FROM h JOIN iv USING (model, strategy, metric)",
    "analysis_transitions": f"WITH {ARM_PAIRS}, x AS ({CASES}) SELECT model, strategy, count(*) AS n_pairs, {', '.join(f'count(*) FILTER ({c}) AS {c}' for c in ('rescued', 'harmed', 'unchanged', 'changed'))}, sum(errors_resolved)::BIGINT AS errors_resolved, sum(errors_introduced)::BIGINT AS errors_introduced FROM x GROUP BY model, strategy",
    "analysis_cases": f"WITH {ARM_PAIRS} {CASES}",
    "generation_audit": f"""WITH {GENERATIONS}, p AS (SELECT id AS k, 'missing' AS problem FROM gl WHERE h IN (0, 1) UNION ALL SELECT DISTINCT 'x', unnest(['unexpected', 'id_mismatch']) FROM gl WHERE h = 1 UNION ALL SELECT 'x', 'conflicting' FROM gl WHERE h = 1 HAVING count(*) > 1
  UNION ALL SELECT id, CASE h WHEN 2 THEN 'run_mismatch' WHEN 3 THEN 'dataset_mismatch' WHEN 4 THEN 'empty_report' WHEN 5 THEN 'empty_report' WHEN 6 THEN 'label_source' WHEN 7 THEN 'labels_missing' WHEN 9 THEN 'conflicting' END FROM gl WHERE h IN (2, 3, 4, 5, 6, 7, 9)
  UNION ALL SELECT id, 'labels_differ' FROM gl WHERE h = 8 AND list_sort(known) <> ['edema', 'fracture']) SELECT problem, count(*) AS n, count(DISTINCT k) AS n_ids FROM p GROUP BY problem""",
    "resume_audit": f"WITH {GENERATIONS} SELECT id AS generation_record_id, CASE h WHEN 4 THEN 'empty_final_report' WHEN 5 THEN 'empty_output_flag' ELSE 'done' END AS state FROM gl WHERE model = 'm1' AND doc_id % 2 = 0 AND h > 2",
    "prediction_audit": f"""WITH x AS (SELECT doc_id::VARCHAR AS id, {draw(quoted('pa'), 'doc_id')} % 20 AS h FROM labels) SELECT CASE WHEN h = 0 THEN 'u' || id ELSE id END AS verifier_record_id, ['unknown', 'truth', 'group', 'unparseable', 'repeated'][h + 1] AS problem FROM x WHERE h < 5""",
    "frame_audit": f"""WITH x AS (SELECT model || '|' || doc_id AS id FROM documents, (VALUES ('m1'), ('m2'), ('m3')) t(model)), y AS (SELECT id, {draw(quoted('fa'), 'id')} % 40 AS h FROM x)
SELECT CASE WHEN h = 3 THEN 'new|' || id ELSE id END AS generation_record_id, ['missing', 'reference_vector_differs', 'runtime_sha256_differs', 'unexpected', 'repeated'][h + 1] AS problem FROM y WHERE h < 5""",
    "recovery_summary": f"WITH {VECTORS}, x AS (SELECT model, condition, CASE WHEN {draw(quoted('rs'), 'doc_id', 'model', 'condition')} % 10 = 0 THEN doc_id % 3 + 1 ELSE 0 END AS n FROM v) SELECT model, condition, count(*) AS n_records, count(*) FILTER (n > 0) AS records_retried, sum(n)::BIGINT AS passes_retried FROM x GROUP BY model, condition",
    "selected_cases": f"WITH {VECTORS} SELECT 'm1|' || doc_id AS case_key, array_to_string(prediction, ',') AS prediction FROM v WHERE model = 'm1' AND condition = 'A' AND doc_id % 20 = 0",
    "value_counts": 'SELECT \'lang\' AS "column", lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT \'source\', source, count(*) FROM documents GROUP BY source',
    "split_summary": f"""WITH x AS (SELECT source, lang, quality = 1 AS verdict, {draw(str(SEED), 'source')} % 10000 AS k FROM labels JOIN documents USING (doc_id)), y AS (SELECT *, CASE WHEN k < 8000 THEN 'train' WHEN k < 9000 THEN 'validation' ELSE 'test' END AS split FROM x),
l AS (SELECT split, string_agg(lang || '=' || n, ',' ORDER BY lang) AS grouping_levels FROM (SELECT split, lang, count(*) AS n FROM y GROUP BY ALL) GROUP BY split) SELECT split, count(*) AS n_examples, count(DISTINCT source) AS n_groups, count(*) FILTER (verdict) AS positive, count(*) FILTER (NOT verdict) AS negative, any_value(grouping_levels) AS grouping_levels FROM y JOIN l USING (split) GROUP BY split""",
    "smoke_subset": "SELECT doc_id, lang FROM documents ORDER BY sha256('7|' || doc_id), doc_id LIMIT 25",
    "work_list": f"""WITH x AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS bundle, doc_id::VARCHAR AS query_record_id, model_key, 'A' AS condition, arm, k FROM documents, (VALUES ('m1'), ('m2')) t(model_key), (VALUES ('text', 0), ('image', 1)) u(arm, k)),
y AS (SELECT *, {draw('7', 'model_key', 'bundle', 'query_record_id', 'condition')} AS pair_seed FROM x) SELECT concat_ws('|', model_key, bundle, query_record_id, condition, arm) AS generation_record_id, model_key, bundle, query_record_id, condition, arm, pair_seed, CASE WHEN pair_seed % 2 = 1 THEN k ELSE 1 - k END AS turn FROM y""",
    "qualitative_means": f"""WITH r AS (SELECT doc_id, letter, f, {draw(quoted('q'), 'f', 'doc_id', 'letter')} % 5 AS base, ({draw(quoted('q'), 'f', quoted('r1'), 'doc_id')} % 4 = 0)::INT AS x, ({draw(quoted('q'), 'f', quoted('r2'), 'doc_id')} % 4 = 0)::INT AS y FROM documents, (VALUES ('X'), ('Y')) t(letter), (VALUES ('accuracy'), ('harm')) u(f)),
m AS (SELECT CASE WHEN (doc_id % 2 = 0) = (letter = 'X') THEN 'B' ELSE 'C' END AS condition, f, CASE WHEN x = y THEN base + x ELSE 2 END AS value FROM r) SELECT condition, round(avg(value) FILTER (f = 'accuracy'), 6) AS accuracy, round(avg(value) FILTER (f = 'harm'), 6) AS harm FROM m GROUP BY condition""",
    "annotator_validation": f"WITH {PEOPLE}, {validated('truth', 'k')} SELECT round(sum(agreement * n) / sum(n), 6) AS cell_agreement, round(avg(kappa), 6) AS macro_kappa, sum(n - yes - neither)::BIGINT AS n_disagreements, max(n) AS n, round(avg(f1), 6) AS macro_f1, round(avg(sensitivity), 6) AS macro_sensitivity, round(avg(specificity), 6) AS macro_specificity, count(f1) AS n_defined_f1 FROM k",
    "annotator_validation_by_label": f"WITH {PEOPLE}, {validated('truth', 'k')} SELECT label, tp, fp, fn, tn, {r6('sensitivity', 'specificity', 'precision', 'f1', 'agreement', 'kappa')} FROM k",
    "single_validation": f"WITH {PEOPLE}, {validated('x', 'k')} SELECT label, tp, fp, fn, tn, {r6('sensitivity', 'specificity', 'precision', 'f1')} FROM k",
    "labeled_export": f"WITH {PEOPLE} SELECT 'b' || doc_id AS blinded_id, doc_id::VARCHAR AS generation_record_id, {', '.join(f'p[{i}] AS {n}' for i, n in enumerate(NAMES, 1))} FROM f",
    "end_to_end_timing": "WITH x AS (SELECT event_id % 3 AS repeat, unnest([3 * value, 3 * value + 1]) AS t FROM events) SELECT repeat, round(quantile_cont(t, 0.25), 6) AS q1, round(quantile_cont(t, 0.5), 6) AS median, round(quantile_cont(t, 0.75), 6) AS q3, round(quantile_cont(t, 0.75) - quantile_cont(t, 0.25), 6) AS iqr, round(avg(t), 6) AS mean, round(quantile_cont(t, 0.95), 6) AS p95 FROM x GROUP BY repeat",
    "hook_scores": f"SELECT doc_id, CASE WHEN {normal('text')} = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM documents",
    "revision_state_machine": f"WITH {revision_passes()} SELECT doc_id::VARCHAR AS record_id, condition, r AS final_report, n_reports, n_verdicts, n_recovered, stop AS stop_reason, n_reports - 1 AS stopping_pass FROM s4",
    "matched_runs": f"WITH {matched_passes()}, x AS (SELECT condition, arm, CASE WHEN NOT failed THEN stop END AS stop_reason, failed, CASE WHEN NOT failed THEN n_reports END AS n_reports FROM s4) SELECT condition, arm, stop_reason, failed, count(*) AS n, coalesce(sum(n_reports), 0)::BIGINT AS n_reports FROM x GROUP BY ALL",
    "align_by_position": "SELECT 'r' || doc_id AS record_id, -doc_id AS vector_id FROM documents",
    "reordered_gallery": f"WITH {MANIFEST} SELECT record_id, 1000000000 - doc_id AS position, study_id FROM m WHERE doc_id % 3 = 0",
    "annotation_strata": f"""WITH {VECTORS}, x AS (SELECT concat_ws('|', model, condition, doc_id) AS id, lang, model, condition, concat_ws('|', lang, model, condition) AS key, count(*) OVER (PARTITION BY lang, model, condition) AS size FROM v), y AS (SELECT *, row_number() OVER (PARTITION BY lang, model, condition ORDER BY {draw(str(SEED), 'id')}, id) AS seat FROM x)
SELECT lang, model, condition, count(*) AS n FROM (SELECT * FROM y ORDER BY CASE WHEN seat = 1 THEN 'infinity'::DOUBLE ELSE size / seat END DESC, key DESC, seat LIMIT 200) GROUP BY ALL""",
    "grouped_split": f"""WITH RECURSIVE {MANIFEST}, sizes AS (SELECT study_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, md5('{SEED}|' || study_id)) AS k FROM m GROUP BY study_id),
fold AS (SELECT 0::BIGINT AS k, 8 * (SELECT count(*) FROM documents) AS a, (SELECT count(*) FROM documents) AS b, (SELECT count(*) FROM documents) AS c, 0::BIGINT AS n, '' AS split UNION ALL
  SELECT s.k, a - CASE pick WHEN 'train' THEN 10 * s.n ELSE 0 END, b - CASE pick WHEN 'validation' THEN 10 * s.n ELSE 0 END, c - CASE pick WHEN 'test' THEN 10 * s.n ELSE 0 END, s.n, pick
  FROM (SELECT *, CASE WHEN b >= a AND b >= c THEN 'validation' WHEN c >= a THEN 'test' ELSE 'train' END AS pick FROM fold) f JOIN sizes s ON s.k = f.k + 1)
SELECT split, sum(n)::BIGINT AS n, count(*) AS n_groups FROM fold WHERE k > 0 GROUP BY split""",
    "holm_with_missing": f"WITH {PV}, h AS ({holm('pv', 'source, lang', 'lang', 'source', True)}) SELECT source, lang, {r6('p_value', 'p_holm')} FROM h",
    "contrast_summary": f"""WITH {PV}, h AS ({holm('pv', 'source, lang', 'lang', 'source')}), d AS (SELECT *, round({draw("'df'", 'source', 'lang')} % 2001 / 1000.0::DOUBLE - 1, 3) AS difference FROM h)
SELECT lang, count(*) AS n_strata, count(*) FILTER (p_holm < 0.05) AS n_significant, count(*) FILTER (difference > 0) AS n_better, count(*) FILTER (difference < 0) AS n_worse, round(median(difference), 6) AS median_difference, round(min(difference), 6) AS min_difference, round(max(difference), 6) AS max_difference FROM d GROUP BY lang""",
    "model_pairs": f"WITH {VECTORS}, x AS (SELECT model, {metrics()['macro_f1']} AS f FROM ({totals('model')})) SELECT a.model AS first, b.model AS second, round(b.f - a.f, 6) + 0.0 AS difference FROM x a JOIN x b ON a.model < b.model",
    "hash_split": f"SELECT source, CASE WHEN k < 8000 THEN 'train' WHEN k < 9000 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM (SELECT source, {draw(str(SEED), 'source')} % 10000 AS k FROM documents) GROUP BY ALL",
    "dhondt_sample": f"""WITH {VECTORS}, x AS (SELECT concat_ws('|', model, condition, doc_id) AS id, lang, model, condition, concat_ws('|', lang, model, condition) AS key, count(*) OVER (PARTITION BY lang, model, condition) AS size FROM v),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, model, condition ORDER BY {draw(str(SEED), 'id')}, id) AS seat FROM x)
SELECT id, lang, model, condition FROM y ORDER BY CASE WHEN seat = 1 THEN 'infinity'::DOUBLE ELSE size / seat END DESC, key DESC, seat LIMIT 200""",
    "blinded_forms": f"SELECT blinded_id, shown, {draw(str(SEED + 1), 'blinded_id')} AS position, {draw(str(SEED + 2), 'blinded_id')} AS second_position FROM (SELECT substr(sha256(concat_ws('|', '{SEED}', doc_id)), 1, 12) AS blinded_id, md5(text) AS shown FROM documents)",
    "case_sample": f"""WITH {JOINT}, x AS (SELECT concat_ws('|', model, doc_id) AS case_key, model, lang, {TAGS} AS tags FROM j), w AS (SELECT *, CASE WHEN contains(tags, 'rescue') THEN 'rescue' ELSE 'harm' END AS direction, CASE WHEN contains(tags, 'strict_') THEN 0 ELSE 1 END AS strict, {draw(str(SEED), 'case_key')} AS h FROM x WHERE tags <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY direction, model, lang ORDER BY h, case_key) AS rk FROM w), p AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY strict, rk, model, lang, h, case_key) AS pl FROM r),
k AS (SELECT least(30, count(*) FILTER (direction = 'rescue')) AS nr, count(*) FILTER (direction = 'harm') AS nh FROM w), f AS (SELECT p.* FROM p, k WHERE (direction = 'rescue' AND pl <= nr) OR (direction = 'harm' AND pl <= least(60 - nr, nh))),
z AS (SELECT * FROM f UNION ALL (SELECT p.* FROM p WHERE case_key NOT IN (SELECT case_key FROM f) ORDER BY strict, h, case_key LIMIT (SELECT 60 - count(*) FROM f)))
SELECT case_key, model, lang, tags, direction, strict, printf('QR-%04d', row_number() OVER (ORDER BY direction, strict, h, case_key)) AS case_number FROM z""",
    "abc_shuffle": f"SELECT doc_id, arm, ['X', 'Y', 'Z'][row_number() OVER (PARTITION BY doc_id ORDER BY {draw(str(SEED), 'doc_id', 'arm')}, arm)] AS letter FROM documents, (VALUES ('B'), ('C'), ('D')) t(arm)",
    "interrater_kappa": f"WITH {FORMS}, c AS (" + " UNION ALL ".join(f"SELECT '{x}' AS label, count(*) AS n, sum(x[{i}] * y[{i}]) AS yes, sum(x[{i}]) AS a, sum(y[{i}]) AS b, sum((1 - x[{i}]) * (1 - y[{i}])) AS neither FROM f" for i, x in enumerate(LABELS, 1)) + f"), k AS (SELECT *, (yes + neither) / n AS ag, (a / n) * (b / n) + (1 - a / n) * (1 - b / n) AS ch FROM c) SELECT label, n, round(ag, 6) AS agreement, round((ag - ch) / {KAPPA}, 6) AS kappa FROM k",
    "adjudication_merge": f"WITH {FORMS} SELECT doc_id, {wrong('x', 'y')} AS n_disagreements, {bits(f'list_transform(range(1, {SIZE + 1}), lambda i: CASE WHEN x[i] = y[i] THEN x[i] ELSE reference[i] END)')} AS ratings FROM f",
    "completeness_audit": f"""WITH {LOG}, p AS (SELECT doc_id, model, condition, count(*) AS n FROM log GROUP BY ALL), e AS (SELECT doc_id, model, condition, true AS wanted FROM documents, (VALUES ('m1'), ('m2'), ('m3')) a(model), (VALUES ('A'), ('B'), ('C')) b(condition))
SELECT model, condition, CASE WHEN n IS NULL THEN 'missing' WHEN wanted IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem, count(*) AS n FROM (SELECT coalesce(e.model, p.model) AS model, coalesce(e.condition, p.condition) AS condition, n, wanted FROM e FULL JOIN p USING (doc_id, model, condition)) WHERE n IS NULL OR wanted IS NULL OR n > 1 GROUP BY ALL""",
    "equivalent_dedup": f"WITH {LOG} SELECT concat_ws('|', model, condition, doc_id) AS id, doc_id, md5(doc_id::VARCHAR) AS payload, count(*) AS n_rows FROM log GROUP BY model, condition, doc_id",
    "pending_ids": f"WITH {LOG} SELECT doc_id, model, condition FROM h WHERE h = 0",
    "record_digest_check": f"SELECT doc_id, 'changed' AS digest FROM documents WHERE {draw(chr(39) + 'tamper' + chr(39), 'doc_id')} % 25 = 0",
    "pairing_audit": f"WITH {LOG}, u AS (SELECT model, doc_id, count(DISTINCT condition) AS a, count(*) AS n FROM log GROUP BY model, doc_id) SELECT model, count(*) AS n_units, count(*) FILTER (a <> 4 OR n <> 4) AS n_bad FROM u GROUP BY model",
    "stage_digest": f"SELECT source, count(*) AS n_rows, bit_xor({draw('text')}) AS xor, sum({draw('text')})::BIGINT AS total FROM documents GROUP BY source",
    "cider": f"""WITH w AS (SELECT doc_id, string_split({normal('text')}, ' ') AS r, list_transform(string_split({normal('text')}, ' '), lambda x, i: CASE WHEN i % 5 = 0 THEN 'x' ELSE x END) AS y FROM documents),
w2 AS (SELECT doc_id, list_filter(r, lambda x: x <> '') AS r, list_filter(y, lambda x: x <> '') AS y FROM w), rg AS ({_grams('r').replace('FROM w,', 'FROM w2,')}), hg AS ({_grams('y').replace('FROM w,', 'FROM w2,')}),
f AS (SELECT k, g, count(*) AS df FROM rg GROUP BY k, g), b AS (SELECT coalesce(rg.doc_id, hg.doc_id) AS doc_id, coalesce(rg.k, hg.k) AS k, coalesce(rg.g, hg.g) AS g, coalesce(rg.tf, 0) AS tr, coalesce(hg.tf, 0) AS th FROM rg FULL JOIN hg USING (doc_id, k, g)),
i AS (SELECT b.*, ln((SELECT count(*) FROM documents)) - ln(greatest(coalesce(df, 1), 1)) AS idf FROM b LEFT JOIN f USING (k, g)),
s AS (SELECT doc_id, k, sum(least(th * idf, tr * idf) * tr * idf) AS dot, sqrt(sum(tr * idf * tr * idf)) AS nr, sqrt(sum(th * idf * th * idf)) AS nh, sum(tr) AS cr, sum(th) AS ch FROM i GROUP BY doc_id, k),
p AS (SELECT doc_id, sum(CASE WHEN nr > 0 AND nh > 0 THEN dot / (nr * nh) ELSE 0 END) AS s, sum(CASE WHEN k = 2 THEN ch - cr ELSE 0 END) AS delta FROM s GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(10.0 * s / 4 * exp(-(delta * delta) / 72.0), 0), 6) AS cider FROM documents d LEFT JOIN p USING (doc_id)""",
}
