"""Scores, labels, votes, evaluation and curation over findings: relational plans, written once and run on Spark and, as twins, on an ANSI engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.ranks import numbered
from . import twins
from .dialect import Ansi, Spark
from .scans import kept


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _case(col: str, table: dict[str, object], other: object = 0) -> str:
    return f"case {col} " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + f" else {other} end"


_RANK = {s: k for k, s in enumerate(fixed.SEVERITIES)}
_WEIGHT = _case("severity", fixed.WEIGHTS)
_SEV = _case("severity", _RANK, 5)
_LABEL = "case {0} when 0 then 'LOW' when 1 then 'MEDIUM' when 2 then 'HIGH' else 'CRITICAL' end"
_SOFT = f"rule_id in ({_list(fixed.SOFT_RULES)})"

#: Findings with what reviewers said of soft ones; for the queries, by the finding's id.
_BASE = f"""f as (select finding_id, skill_id, path, segment_id, segment_type, rule_id, severity, category, flags, line, context, source_kind, coalesce(reference_example, false) as reference_example, coalesce(bootstrap, false) as bootstrap, 'deterministic' as layer, cast(null as double) as confidence,
    {_SOFT} as soft, case when {_SOFT} then case when substr(finding_id, 1, 1) < '6' then 'confirmed' when substr(finding_id, 1, 1) < 'c' then 'rejected' else 'pending' end end as soft_status from findings)"""


def _score(d) -> str:
    """Points off per finding: severity weight, times confidence, less by a third for each stronger one of its severity; parts of chains, rejected and pending soft findings don't count."""
    return f"""absorbed as (select distinct ref as finding_id from refs where rule_id like 'D-19%'),
effective as (select f.* from f left join absorbed a on f.finding_id = a.finding_id where a.finding_id is null and (not soft or soft_status = 'confirmed')),
supp as (select skill_id, max(case when flags like '%,SUPPRESSION_PRESENT,%' then 1 else 0 end) as active from f group by skill_id),
ranked as (select e.*, s.active, row_number() over (partition by e.skill_id, severity order by coalesce(confidence, 1.0) desc, finding_id) - 1 as place from effective e join supp s on e.skill_id = s.skill_id),
points as (select *, {_WEIGHT} * coalesce(confidence, 1.0) * power({fixed.DECAY}, place) * (case when soft_status = 'confirmed' then {fixed.CONFIRMED_BOOST} else 1.0 end)
    * (case when active = 1 and not flags like '%,SUPPRESSION_PRESENT,%' then {fixed.SUPPRESSION_FACTOR} else 1.0 end) as off from ranked),
per as (select skill_id, sum(off) as off, min({_SEV}) as worst, count(*) as effective, sum(case when soft_status = 'confirmed' then 1 else 0 end) as confirmed from points group by skill_id),
alls as (select f.skill_id, count(*) as n, sum(case when soft and soft_status <> 'confirmed' then 1 else 0 end) as rejected, sum(case when a.finding_id is not null then 1 else 0 end) as absorbed from f left join absorbed a on f.finding_id = a.finding_id group by f.skill_id),
rawscores as (select b.skill_id, cast(coalesce(greatest(0, least(100, {d.bankers('100.0 - off')})), 100) as int) as raw_score, coalesce(off, 0) as off, coalesce(worst, 5) as worst, coalesce(effective, 0) as effective, coalesce(confirmed, 0) as confirmed, coalesce(rejected, 0) as rejected, coalesce(absorbed, 0) as absorbed, coalesce(n, 0) as n
    from bundles b left join per on b.skill_id = per.skill_id left join alls on b.skill_id = alls.skill_id),
scored as (select *, least(raw_score, case worst when 0 then {fixed.SCORE_CAPS['critical']} when 1 then {fixed.SCORE_CAPS['high']} else 100 end) as score from rawscores),
results as (select *, case when score >= 80 then 'SAFE' when score >= 60 then 'LOW RISK' when score >= 40 then 'MEDIUM RISK' when score >= 20 then 'HIGH RISK' else 'CRITICAL' end as verdict from scored)"""


_BOOT = "(bootstrap and (category in ('persistence', 'cross_agent') or rule_id in ('D-10A', 'D-10D')))"
_REF = "(reference_example and source_kind = 'markdown')"
_MEDIUM = "severity in ('critical', 'high', 'medium')"
_HIGH = "severity in ('critical', 'high')"


def _labels(d) -> str:
    """Risk labels: facts per bundle in one aggregate, then a ladder."""
    dangerous, contexts = _list(fixed.DANGEROUS_CATEGORIES), _list(fixed.PROMOTABLE_CONTEXTS)
    promotes = f"""case when {_BOOT} then false when rule_id = 'D-9A' and severity = 'medium' then false when category not in ({dangerous}) then false when not {_MEDIUM} then false
      when rule_id in ({_list(fixed.EXPLICIT_RULES)}) then true when {_REF} then false when context in ({contexts}) then true when context = 'documentation' then false
      when source_kind in ('code', 'frontmatter_description') then true when source_kind = 'markdown' then false else true end"""
    some = lambda c: f"max(case when {c} then 1 else 0 end)"
    count = lambda c: f"sum(case when {c} then 1 else 0 end)"
    sub = f"(corr = 1 and not {_REF} and not {_BOOT})"
    return f"""active as (select *, case when soft and soft_status = 'pending' then 0 else 1 end as corr, row_number() over (partition by skill_id, rule_id, category, path order by line, finding_id) as first_active,
    row_number() over (partition by skill_id, rule_id, category, path, case when soft and soft_status = 'pending' then 0 else 1 end order by line, finding_id) as first_corr from f where coalesce(soft_status, '') <> 'rejected'),
facts as (select skill_id,
    {count(f"{sub} and {_HIGH} and first_corr = 1")} as high_sub, {count(f"{sub} and first_corr = 1")} as n_sub, {some(f"corr = 1 and first_corr = 1 and {_BOOT}")} as boot,
    {some(f"corr = 1 and first_corr = 1 and severity = 'medium' and category in ({dangerous}) and not {_REF} and not {_BOOT} and (context in ({contexts}) or source_kind in ('code', 'frontmatter_description') or (context is null and source_kind is null))")} as medium_dangerous,
    {some("severity = 'critical' and first_active = 1")} as critical_active, {count("rule_id like 'D-19%'")} as n_chains,
    {some(f"corr = 1 and first_corr = 1 and {_HIGH} and category in ('credential_theft', 'persistence') and {promotes}")} as promoted_theft,
    {count(f"first_active = 1 and {_HIGH} and category = 'obfuscation' and not {_REF}")} as high_obfuscation, {some(f"corr = 1 and first_corr = 1 and {promotes}")} as promoted,
    {some(f"first_active = 1 and category = 'prompt_injection' and not {_REF}")} as injection, {some(f"{sub} and first_corr = 1 and category = 'suppression'")} as suppression,
    {some(f"corr = 1 and first_corr = 1 and rule_id in ({_list(fixed.EXPLICIT_RULES)}) and not {_BOOT}")} as explicit_rule,
    {some("first_active = 1 and rule_id in ('D-3A', 'D-4B', 'D-5A', 'D-5B', 'D-5C')")} as encoded, {some(f"first_active = 1 and rule_id in ('D-10A', 'D-10D') and context in ({contexts})")} as executes, {some("first_active = 1 and (rule_id in ('D-15C', 'D-15D') or (rule_id = 'D-15E' and context in ('actionable_instruction', 'executable_snippet')))")} as remote,
    {some(f"{sub} and first_corr = 1 and category = 'cross_agent'")} as cross_agent, {some(f"{sub} and first_corr = 1 and category in ('persistence', 'behavioral', 'jailbreak', 'credential_theft', 'data_exfiltration')")} as acting,
    {some("soft_status = 'confirmed' and category = 'credential_theft'")} as sure_theft, {some("soft_status = 'confirmed' and category = 'data_exfiltration'")} as sure_exfiltration, {some("category in ('persistence', 'behavioral')")} as guarded
    from active group by skill_id),
ladder as (select *, case when (sure_theft = 1 and sure_exfiltration = 1) or n_chains >= 2 then 3
      when critical_active = 1 or n_chains > 0 or high_sub >= 2 or promoted_theft = 1 or high_obfuscation >= 2 or promoted = 1 or (injection = 1 and suppression = 1) or explicit_rule = 1 or (encoded = 1 and executes = 1 and remote = 1) then 2
      when high_sub > 0 or boot = 1 or medium_dangerous = 1 or n_sub >= 2 then 1 else 0 end as base,
    case when sure_theft = 1 and sure_exfiltration = 1 then 3 when n_chains > 0 and guarded = 1 then 2 else 0 end as floor_rank from facts),
risk as (select b.skill_id, coalesce(base, 0) as base_rank, coalesce(floor_rank, 0) as floor_rank,
    coalesce(greatest(base, floor_rank, case when base < 3 and (suppression = 1 or (cross_agent = 1 and acting = 1)) then 2 else 0 end), 0) as rank from bundles b left join ladder on b.skill_id = ladder.skill_id)"""


def _decisive(d) -> str:
    some = lambda c: f"max(case when {c} then 1 else 0 end)"
    distinct = lambda c, x="rule_id": f"count(distinct case when {c} then {x} end)"
    ob, be, ex, cr = (f"rule_id in ({_list(x)})" for x in (fixed.DECISIVE_OBFUSCATION, fixed.DECISIVE_BEHAVIOUR, fixed.DECISIVE_EXFILTRATION, fixed.DECISIVE_CREDENTIAL))
    return f"""used as (select *, row_number() over (partition by skill_id, rule_id, category, path order by line, finding_id) as first_one from f where not {_REF} and not {_BOOT}),
d as (select skill_id, {some(f"first_one = 1 and rule_id in ('D-3A', 'D-4B', 'D-5A', 'D-5B', 'D-5C') and {_HIGH}")} as encoded, {some(f"first_one = 1 and rule_id in ('D-10A', 'D-10D') and context in ({_list(fixed.PROMOTABLE_CONTEXTS)})")} as executes, {some("first_one = 1 and rule_id in ('D-15C', 'D-15D')")} as remote,
    {some("rule_id like 'D-19%'")} as chained, {some(f"rule_id = 'D-20H' and {_MEDIUM}")} as fake, {some(f"first_one = 1 and {be} and {_MEDIUM}")} as behaves, {some(f"first_one = 1 and {be} and {_HIGH}")} as behaves_high, {some(f"first_one = 1 and {cr} and {_MEDIUM}")} as credential, {some(f"first_one = 1 and {cr} and {_HIGH}")} as credential_high,
    sum(case when {ob} and {_HIGH} then 1 else 0 end) as n_obfuscated, {distinct(f"{ob} and {_HIGH}")} as kinds, {some(f"first_one = 1 and {ex} and {_MEDIUM}")} as leaks, {some("rule_id = 'NC-3A'")} as folded from used group by skill_id),
decisive as (select skill_id, case when (encoded = 1 and executes = 1 and remote = 1) or chained = 1 or (fake = 1 and (behaves = 1 or credential = 1 or n_obfuscated >= 2 or kinds >= 2 or (n_obfuscated > 0 and leaks = 1)))
    or (credential_high = 1 and (behaves_high = 1 or leaks = 1) and (n_obfuscated > 0 or folded = 1)) then 1 else 0 end as decisive from d)"""


_TRUTH = """truth as (select d.source as skill_id, case when max(l.toxic) = 1 and avg(cast(l.toxic as double)) > 0.12 then 'MALICIOUS' when min(l.quality) = 0 and avg(cast(l.quality as double)) < 0.6 then 'AMBIGUOUS' else 'SAFE' end as verdict,
    case when sum(l.toxic) > 4 then 'critical' when sum(l.toxic) > 2 then 'high' else 'medium' end as severity from documents d join labels l on d.doc_id = l.doc_id group by d.source)"""


def _outcomes(d, rank: str = "rank", name: str = "outcomes", cutoff: int = 2) -> str:
    return f"""{name} as (select l.skill_id, t.verdict, t.severity as true_severity, l.{rank} as rank, case when t.verdict = 'AMBIGUOUS' then 'EXCLUDED' when t.verdict = 'MALICIOUS' then case when l.{rank} >= {cutoff} then 'TP' else 'FN' end else case when l.{rank} >= {cutoff} then 'FP' else 'TN' end end as outcome
    from labels_ l join truth t on l.skill_id = t.skill_id)"""


_METRICS = """select {0} count(*) as n, sum(case when outcome = 'TP' then 1 else 0 end) as tp, sum(case when outcome = 'FP' then 1 else 0 end) as fp, sum(case when outcome = 'TN' then 1 else 0 end) as tn, sum(case when outcome = 'FN' then 1 else 0 end) as fn"""
_RATIOS = """tp, fp, tn, fn, round(coalesce(tp / cast(nullif(tp + fp, 0) as double), 0), 6) as precision_, round(coalesce(tp / cast(nullif(tp + fn, 0) as double), 0), 6) as recall_, round(coalesce(2.0e0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, round(coalesce(fp / cast(nullif(fp + tn, 0) as double), 0), 6) as fpr, round(coalesce((tp + tn) / cast(nullif(tp + fp + tn + fn, 0) as double), 0), 6) as accuracy"""


def _q_score(d):
    return ["base", _score(d)], "select skill_id, raw_score, score, verdict, n as findings from results"


def _q_details(d):
    return ["base", _score(d)], "select skill_id, round(off, 2) as total_deduction, effective, confirmed, rejected, absorbed, case when score <> raw_score then 1 else 0 end as capped from results"


def _q_grouping(d):
    return ["base"], "select severity, layer, category, count(*) as n from f group by grouping sets ((severity), (layer), (category), ())"


def _q_pooled(d):
    pooled = "bundles", "(select 'pooled' as skill_id) bundles_"
    sql = _score(d).replace("from bundles b", "from (select 'pooled' as skill_id) b")
    return ["base0", "f as (select * exclude_ from (select f0.*, 'pooled' as pool from f0))".replace("* exclude_", "finding_id, pool as skill_id, path, segment_id, segment_type, rule_id, severity, category, flags, line, context, source_kind, reference_example, bootstrap, layer, confidence, soft, soft_status"), sql], "select skill_id, raw_score, score, verdict, n as findings from results"


def _q_files(d):
    return ["base"], f"select skill_id, path, count(*) as findings, min({_SEV}) as worst, {d.joined('category')} as categories from f group by skill_id, path"


def _q_evidence(d):
    kinds = {"confirmed": "soft_status = 'confirmed'", "disputed": "soft_status = 'rejected'", "chains": "rule_id like 'D-19%'", "high_signal": f"rule_id in ({_list(fixed.EXPLICIT_RULES)})"}
    cols = ", ".join(f"sum(case when {c} then 1 else 0 end) as n_{k}, {d.joined(f'case when {c} then category end')} as {k}_categories" for k, c in kinds.items())
    return ["base"], f"select skill_id, count(distinct path) as files, {cols} from f group by skill_id"


def _q_labels(d):
    return ["base", _labels(d)], f"select skill_id, {_LABEL.format('base_rank')} as base_label, {_LABEL.format('rank')} as risk_label, case when rank >= 2 then 'MALICIOUS' else 'SAFE' end as binary_label from risk"


def _q_floor(d):
    return ["base", _labels(d)], f"select skill_id, {_LABEL.format('floor_rank')} as floor_label from risk"


def _q_decisive(d):
    return ["base", _decisive(d)], "select skill_id, decisive from decisive"


def _q_gate(d):
    high = f"count(distinct case when rule_id in ({_list(fixed.REVIEW_BYPASS_RULES)}) and {_HIGH} then finding_id end)"
    return ["base", _decisive(d), f"g as (select skill_id, {high} as strong from f group by skill_id)"], "select g.skill_id, case when coalesce(decisive, 0) = 1 or strong >= 2 then 1 else 0 end as skip_review from g left join decisive on g.skill_id = decisive.skill_id"


def _q_policy(d):
    return ["base", "n as (select *, row_number() over (partition by skill_id, rule_id, category, path order by line, finding_id) as k from f)"], "select skill_id, rule_id, category, path, line from n where k = 1"


_TARGETS = f"""targets as (select skill_id, path, max(case when source_kind = 'code' then 90 else 100 end) + max(case when soft then 60 else 0 end) + max(case when path like '%references/%' then 0 else 15 end)
    + sum(case severity when 'critical' then 45 when 'high' then 30 when 'medium' then 15 when 'low' then 5 else 0 end) + sum(case when category in ('credential_theft', 'data_exfiltration') then 40 when category in ('supply_chain', 'behavioral', 'persistence', 'prompt_injection') then 20 else 0 end)
    + sum(case when rule_id like 'D-19%' then 50 else 0 end) as points, max(case when {_HIGH} then 0 else 1 end) as secondary from f group by skill_id, path),
s1 as (select *, row_number() over (partition by skill_id, secondary order by points desc, path) as k from targets),
s2 as (select *, row_number() over (partition by skill_id order by secondary, points desc, path) as place, count(*) over (partition by skill_id) as n from s1 where secondary = 0 or k <= 3)"""


def _q_targets(d):
    return ["base", _TARGETS], "select skill_id, path, points, secondary, place from s2 where place <= 8"


def _q_jobs(d):
    has = lambda f: f"flags like '%,{f},%'"
    target = f"""case when ({has('READ_SENSITIVE')} and {has('NETWORK_SEND')}) or category = 'data_exfiltration' then 'LLM-TGT-EXFIL' when {has('EXEC_DYNAMIC')} then 'LLM-TGT-EXEC' when {has('WRITE_SYSTEM')} then 'LLM-TGT-PERSIST'
      when {has('CROSS_AGENT')} then 'LLM-TGT-CROSS' when {has('TEMPORAL_TRIGGER')} then 'LLM-TGT-TIME' when category = 'obfuscation' then 'LLM-TGT-OBF' else 'LLM-TGT-VERIFY' end"""
    jobs = f"""c as (select *, {target} as target from f where soft or category in ('obfuscation', 'prompt_injection', 'credential_theft', 'suppression') or rule_id like 'D-19%' or flags <> ','),
j as (select skill_id, path, target, category, count(*) as n, 'hard' as kind from c where not soft group by skill_id, path, target, category union all select skill_id, path, target, category, 1, 'soft' from c where soft)"""
    return ["base", jobs], "select skill_id, path, target, category, kind, sum(n) as findings, count(*) as jobs from j group by skill_id, path, target, category, kind"


#: Three votes on each soft finding, from its id.
_VOTES = """votes as (select finding_id, skill_id, category, m.model, case when substr(finding_id, m.model, 1) < '9' then 'confirm' when substr(finding_id, m.model, 1) < 'd' then 'dispute' else 'informational' end as disposition,
    (case when substr(finding_id, m.model + 4, 1) < '8' then 0.6e0 else 0.9e0 end) as confidence, case when substr(finding_id, m.model + 8, 1) < '5' then 'HIGH' when substr(finding_id, m.model + 8, 1) < 'b' then 'MEDIUM' else 'LOW' end as label from f cross join (select 1 as model union all select 2 union all select 3) m where soft)"""


def _q_consensus(d):
    return ["base", _VOTES], f"select finding_id, round(avg(case when disposition = 'confirm' then 1.0e0 else 0.0e0 end), 6) as share, case when avg(case when disposition = 'confirm' then 1.0e0 else 0.0e0 end) >= {fixed.CONSENSUS} then 'confirmed' else 'rejected' end as status from votes group by finding_id"


def _q_mode(d):
    return ["base", _VOTES, "c as (select finding_id, disposition, count(*) as n, min(model) as first_seen, avg(confidence) as mean from votes group by finding_id, disposition), r as (select *, row_number() over (partition by finding_id order by n desc, first_seen) as k from c)"], "select finding_id, disposition, n, round(mean, 6) as confidence from r where k = 1"


def _q_majority(d):
    rank = "case label when 'LOW' then 0 when 'MEDIUM' then 1 when 'HIGH' then 2 else 3 end"
    return ["base", _VOTES, _labels(d), f"c as (select skill_id, label, {rank} as vote_rank, count(*) as n, round(avg(confidence), 6) as mean from votes group by skill_id, label), r as (select *, row_number() over (partition by skill_id order by n desc, mean desc, vote_rank desc) as k from c)"], f"select r.skill_id, label as majority, n, mean, {_LABEL.format('greatest(vote_rank, floor_rank)')} as final_label from r join risk on r.skill_id = risk.skill_id where k = 1"


def _scores(d) -> str:
    """Scores of three simple models for each document: the shares of digits and signs, of shouting, and of requests in its text, scaled to 1 at most."""
    n = "greatest(length(text), 1)"
    size = "size" if d.name == "spark" else "len"
    share = lambda p, by: f"least(1.0e0, {by}e0 * {size}({d.found('text', p)}) / {n})"
    return f"""scores as (select doc_id, model, w, floor(1000 * case model when 1 then {share('[0-9@#%$&*_=<>{}]', 20)} when 2 then {share('[A-Z]', 15)} else {share('(?i)the|and|you|please|must', 60)} end) / 1000.0e0 as s
    from (select doc_id, coalesce(text, '') as text from documents) t_ cross join (select 1 as model, 0.40e0 as w union all select 2, 0.35e0 union all select 3, 0.25e0) m),
ens as (select doc_id, sum(s * w) / sum(w) as score, avg(s) as mean, least(1.0, 2 * stddev_pop(s)) as disagreement, max(s) as top from scores group by doc_id)"""


def _q_ensemble(d):
    return [_scores(d)], "select doc_id, round(score, 6) as score, round(mean, 6) as mean, round(disagreement, 6) as disagreement, top, case when round(score, 9) >= 0.5 then 1 else 0 end as triggered from ens"


def _q_ml(d):
    return [_scores(d)], "select doc_id, case when round(score, 9) >= 0.75 then 'high' else 'medium' end as severity, case when round(score, 9) < 0.85 then 1 else 0 end as soft from ens where round(score, 9) >= 0.5"


_EVAL = lambda d: ["base", _labels(d), "labels_ as (select * from risk)", _TRUTH, _outcomes(d)]


def _q_confusion(d):
    return [*_EVAL(d), f"m as ({_METRICS.format('')} from outcomes)"], f"select n, {_RATIOS} from m"


def _q_recall(d):
    expected = "e as (select skill_id, 'prompt_injection' as category from truth where verdict = 'MALICIOUS' union all select skill_id, 'credential_theft' from truth where verdict = 'MALICIOUS' union all select skill_id, 'supply_chain' from truth where verdict = 'MALICIOUS')"
    return ["base", _TRUTH, expected, "h as (select distinct skill_id, category from f)"], "select e.category, count(*) as expected, sum(case when h.skill_id is not null then 1 else 0 end) as found_in, round(sum(case when h.skill_id is not null then 1.0e0 else 0.0e0 end) / count(*), 6) as recall_ from e left join h on e.skill_id = h.skill_id and e.category = h.category group by e.category"


def _q_coverage(d):
    rules_ = "x as (select 'D-11A' as rule_id union all select 'D-9A' union all select 'D-20H' union all select 'D-1D')"
    return ["base", _TRUTH, rules_, "h as (select distinct skill_id, rule_id from f)"], "select t.skill_id, sum(case when h.rule_id is not null then 1 else 0 end) as met, sum(case when h.rule_id is null then 1 else 0 end) as missed from truth t cross join x left join h on h.skill_id = t.skill_id and h.rule_id = x.rule_id group by t.skill_id"


def _q_severity(d):
    worst = f"w as (select skill_id, min({_SEV}) as worst from f group by skill_id)"
    diff = f"(worst - {_case('true_severity', _RANK)})"
    return [*_EVAL(d), worst], f"select count(*) as n, round(avg(cast(abs({diff}) as double)), 6) as mean_error, round(avg(case when {diff} > 0 then 1.0e0 else 0.0e0 end), 6) as under, round(avg(case when {diff} < 0 then 1.0e0 else 0.0e0 end), 6) as over_ from outcomes o join w on o.skill_id = w.skill_id where outcome = 'TP'"


def _q_latency(d):
    p = lambda x: d.percentile("value", x)
    return [], f"select event_type as layer, count(*) as n, {p(0.5)} as p50, {p(0.95)} as p95, {p(0.99)} as p99, round(count(*) / sum(value), 6) as throughput from events where value is not null group by event_type"


_TWO = lambda d: ["base", _labels(d), "labels_ as (select * from risk)", _TRUTH, _outcomes(d, name="run_a", cutoff=3), _outcomes(d, name="run_b", cutoff=2)]


def _q_regression(d):
    good = "('TP', 'TN')"
    return _TWO(d), f"select coalesce(a.skill_id, b.skill_id) as skill_id, a.outcome as before_, b.outcome as after_, case when a.outcome in {good} and b.outcome not in {good} then 'new failure' when a.outcome not in {good} and b.outcome in {good} then 'fix' else 'same' end as change from run_a a full outer join run_b b on a.skill_id = b.skill_id where coalesce(a.outcome, '') <> 'EXCLUDED'"


def _q_compare(d):
    both = f"m as ({_METRICS.format('0 as run,')} from run_a union all {_METRICS.format('1 as run,')} from run_b), r as (select run, {_RATIOS} from m)"
    cols = ("precision_", "recall_", "f1", "fpr", "accuracy")
    long = " union all ".join(f"select '{c}' as metric, max(case when run = 0 then {c} end) as a, max(case when run = 1 then {c} end) as b from r" for c in cols)
    return [*_TWO(d), both, f"l as ({long})"], "select metric, a, b, round(b - a, 6) as delta from l"


def _q_gate_regression(d):
    good = "('TP', 'TN')"
    return _TWO(d), f"select max(case when a.outcome in {good} and b.outcome not in {good} then 1 else 0 end) as regressed, sum(case when a.outcome in {good} and b.outcome not in {good} then 1 else 0 end) as n from run_a a join run_b b on a.skill_id = b.skill_id"


def _q_errors(d):
    first = "e as (select o.skill_id, o.outcome, (select min(f.rule_id) from f where f.skill_id = o.skill_id) as first_rule from outcomes o where outcome in ('FP', 'FN')), r as (select *, row_number() over (partition by outcome, first_rule order by skill_id) as k, count(*) over (partition by outcome, first_rule) as n from e)"
    return [*_EVAL(d), first], "select outcome, first_rule, skill_id, k, greatest(n - 3, 0) as more from r where k <= 3"


def _q_concerning(d):
    return ["base", _score(d), "c as (select skill_id, score, round((5 - worst) * (1 - score / 100.0e0), 6) as concern from results), t as (select * from c order by concern desc, skill_id limit 10), r as (select *, row_number() over (order by concern desc, skill_id) as k from t)"], "select skill_id, score, concern, k from r"


def _q_ambiguous(d):
    return [*_EVAL(d)], f"select {_LABEL.format('rank')} as risk_label, count(*) as n from outcomes where verdict = 'AMBIGUOUS' group by rank"


def _q_tiers(d):
    return ["r as (select doc_id, source, row_number() over (partition by source order by doc_id) as round_ from documents), o as (select *, row_number() over (order by round_, source) as place from r)"], "select doc_id, source, place, case when place <= 20 then 'smoke' when place <= 50 then 'standard' else 'full' end as tier from o"


_PLANTED = lambda d: "a as (select path, content from artifacts)"


def _has(words, col="lower(content)"):
    return "(" + " or ".join(f"{col} like '%{w}%'" for w in words) + ")"


def _q_family(d):
    theft = _has(("webhook.site", "analytics", "~/.ssh", "~/.aws", "api key", "api_key", "token", "credential", "password", "private key", "seed phrase"))
    quiet = _has(("do not ask", "do not mention", "without asking", "silently"))
    asks = _has(("do not ask", "don_t ask", "without asking", "do not mention", "don_t mention", "silently"))
    hook = _has(("webhook.site", "base64", "hook", ".mcp.json"))
    return ["artifacts", _PLANTED(d)], f"""select path, case when {theft} then 1 else 0 end as credential_theft, case when {asks} then 1 else 0 end as prompt_injection, case when {theft} then 'critical' when {asks} and {_has(("do not ask", "do not mention", "silently"))} then 'critical' else 'high' end as severity,
      case when {asks} or {hook} then 'hard' else 'medium' end as difficulty, case when {quiet} then 'instruction-hijack' when {_has(("webhook.site",))} then 'direct-exfil' when {_has(("authtool",))} then 'fake-prerequisite' when {_has(("base64",))} then 'inline-bootstrap' else 'generic-bootstrap' end as family from a"""


def _q_defang(d):
    safe = "__SAFE__"
    url = r"https?://[^\s\"'>)}\]]+"
    keep = r"(https?)://((?:localhost|127\.0\.0\.1|example\.com|httpbin\.org|evil\.example\.com)[^\s\"'>)}\]]*)"
    ip = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?\b"
    keep_ip = r"\b(127)\.(0\.0\.1)\b|\b(0)\.(0\.0\.0)\b|\b(169)\.(254\.169\.254)\b"
    marked = d.replace("content", keep, rf"{safe}{'$1' if d.name == 'spark' else chr(92) + '1'}#{'$2' if d.name == 'spark' else chr(92) + '2'}")
    gone = d.replace(marked, url, "https://evil.example.com/DEFANGED")
    back = d.replace(gone, rf"{safe}(https?)#", "$1://" if d.name == "spark" else r"\1://")
    for a in ("127.0.0.1", "0.0.0.0", "169.254.169.254"):
        back = f"replace({back}, '{a}', '{a.replace('.', '~')}')"
    out = d.replace(back, ip, "192.0.2.1")
    for a in ("127.0.0.1", "0.0.0.0", "169.254.169.254"):
        out = f"replace({out}, '{a.replace('.', '~')}', '{a}')"
    return ["artifacts", _PLANTED(d)], f"select path, md5({out}) as digest, length({out}) as n from a"


def _q_taxonomy(d):
    rows = " union all ".join(f"select '{k}' as pattern, '{c}' as category" for k, v in fixed.TAXONOMY.items() for c in v)
    names = list(fixed.TAXONOMY)
    pick = "case doc_id % 7 " + " ".join(f"when {k} then '{names[2 * k]};{names[2 * k + 1]}'" for k in range(7)) + " end"
    given = f"g as (select doc_id, {pick} as patterns from documents)"
    apart = f"e as (select doc_id, p from g {d.each(d.words('patterns', ';'), 'p')})" if d.name == "spark" else f"e as (select doc_id, t_p.p as p from g {d.each(d.words('patterns', ';'), 'p')})"
    return [f"t as ({rows})", given, apart], f"select doc_id, {d.joined('category')} as categories from e join t on t.pattern = e.p group by doc_id"


def _q_slug(d):
    return [], f"select page_id, {d.replace('lower(url)', '[^a-z0-9]+', '-')} as slug, substr(md5(url), 1, 8) as short from pages"


def _q_budget(d):
    return ["artifacts"], "select skill_id, sum(length(content)) as chars, cast(floor(sum(length(content)) / 4.0e0) as bigint) as tokens, case when sum(length(content)) / 4.0e0 <= 30000 then 1 else 0 end as fits from artifacts group by skill_id"


_PLANS: dict[str, Callable] = {
    "score_by_skill": _q_score, "score_details": _q_details, "score_grouping_sets": _q_grouping, "score_pooled": _q_pooled, "file_evidence": _q_files, "evidence_packet": _q_evidence, "risk_labels": _q_labels, "guardrail_floor": _q_floor, "decisive_combo": _q_decisive,
    "review_gate": _q_gate, "policy_dedup": _q_policy, "review_targets_topk": _q_targets, "review_jobs": _q_jobs, "vote_consensus": _q_consensus, "vote_mode": _q_mode, "vote_majority": _q_majority, "ml_ensemble": _q_ensemble, "ml_soft_findings": _q_ml,
    "confusion_matrix": _q_confusion, "category_recall": _q_recall, "rule_coverage": _q_coverage, "severity_error": _q_severity, "latency_percentiles": _q_latency, "regression_delta": _q_regression, "run_compare": _q_compare, "regression_gate": _q_gate_regression,
    "error_analysis": _q_errors, "most_concerning": _q_concerning, "ambiguous_labels": _q_ambiguous, "tier_round_robin": _q_tiers, "infer_family": _q_family, "defang": _q_defang, "taxonomy_map": _q_taxonomy, "page_slugs": _q_slug, "bundle_budget": _q_budget,
}


def _spark(plan: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..sources import tables

        parts, last = plan(Spark)
        text = "with " + ",\n".join(p for p in parts if p not in ("base", "base0", "artifacts")) + "\n" if any(p not in ("base", "base0", "artifacts") for p in parts) else ""
        base = _BASE.replace("f as", "f0 as", 1) if "base0" in parts else _BASE if "base" in parts else ""
        text = text.replace("with ", f"with {base},\n", 1) if base and text else f"with {base}\n" if base else text
        frames: dict[str, DataFrame] = {}
        if base:
            found = kept(spark, sf_dir, "findings")
            frames |= {"findings": found, "refs": found.selectExpr("finding_id", "rule_id", "explode(references) as ref")}
        for name in ("documents", "labels", "pages", "events", "artifacts", "bundles", "findings", "refs"):
            if name not in frames and f" {name}" in text + last:
                frames[name] = tables.planted(spark, sf_dir) if name == "artifacts" else spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("source as skill_id").distinct() if name == "bundles" else spark.read.parquet(f"{sf_dir}/{name}.parquet")
        for name, frame in frames.items():
            frame.createOrReplaceTempView(name)
        return spark.sql(text + last)

    return run


def _ansi(plan: Callable) -> str:
    parts, last = plan(Ansi)
    head = []
    if "base" in parts or "base0" in parts:
        head.append(twins.scan().removeprefix("with ").rstrip())
        head.append("findings as (select * from everything)")
        head.append("refs as (select finding_id, rule_id, unnest(refs) as ref from everything)")
        head.append("bundles as (select distinct source as skill_id from documents)")
        head.append(_BASE.replace("f as", "f0 as", 1) if "base0" in parts else _BASE)
    elif "artifacts" in parts:
        head.append(twins.artifacts())
    head += [p for p in parts if p not in ("base", "base0", "artifacts")]
    return ("with " + ",\n".join(head) + "\n" if head else "") + last


QUERIES = {name: _spark(plan) for name, plan in _PLANS.items()}
ORACLE_SQL = {name: _ansi(plan) for name, plan in _PLANS.items()}


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as the plan for the other engine, by row numbers in two levels: no task sees all rows, nor all of a source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    place = numbered(numbered(docs, "round_", "doc_id", within=("source",)), "place", "round_", "source")
    return place.select("doc_id", "source", "place", F.expr("case when place <= 20 then 'smoke' when place <= 50 then 'standard' else 'full' end").alias("tier"))


QUERIES["tier_round_robin"] = _tiers
