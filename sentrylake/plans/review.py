"""Review, drivers, golden comparison and corpus curation: further relational plans over findings and tables, written once for both engines."""

from __future__ import annotations

from collections.abc import Callable

from ..functions import fixed
from .relational import _HIGH, _LABEL, _MEDIUM, _METRICS, _RATIOS, _REF, _SEV, _TARGETS, _TRUTH, _VOTES, _ansi, _decisive, _labels, _list, _outcomes, _spark

_EVAL = lambda d: ["base", _labels(d), "labels_ as (select * from risk)", _TRUTH, _outcomes(d)]


def _q_needs_vote(d):
    """A final vote is needed from HIGH on, unless a decisive combination or a chain settles the label already."""
    chained = "chained as (select distinct skill_id from f where rule_id like 'D-19%')"
    need = "rank >= 2 and coalesce(decisive, 0) = 0 and c.skill_id is null"
    return ["base", _labels(d), _decisive(d), chained], f"select r.skill_id, {_LABEL.format('rank')} as risk_label, case when {need} then 1 else 0 end as needs_vote from risk r left join decisive x on r.skill_id = x.skill_id left join chained c on r.skill_id = c.skill_id"


def _q_drivers(d):
    """The three drivers of a bundle's label: of findings of high signal, else of chains, else of models, else the first finding."""
    kind = f"case when rule_id in ({_list(fixed.EXPLICIT_RULES)}) and rule_id not like 'D-19%' then 0 when rule_id like 'D-19%' then 1 when layer = 'ml_ensemble' then 2 else 3 end"
    parts = f"k as (select *, {kind} as kind, min({kind}) over (partition by skill_id) as best from f), r as (select *, row_number() over (partition by skill_id order by path, line, finding_id) as place from k where kind = best)"
    return ["base", parts], "select skill_id, rule_id, category, path, finding_id, kind, place from r where place <= case when kind = 3 then 1 else 3 end"


#: A general review of each bundle's first three files and a targeted one of all chosen files, as findings of the review layer.
_REVIEWS = f"""{_TARGETS},
reviews as (select skill_id, path, 'LLM-GEN' as rule_id, 'medium' as severity from s2 where place <= 3 union all select skill_id, path, 'LLM-TGT-EXEC', case when points > 150 then 'high' else 'medium' end from s2 where place <= 8)"""


def _q_corroborated(d):
    """Which of the review layer's findings count: a general one needs a finding of another layer in its file that is of medium severity or not structural; a targeted medium one in Markdown needs a high one. Reference examples support nothing."""
    support = f"support as (select skill_id, path, max(case when {_MEDIUM} or category <> 'structural' then 1 else 0 end) as some_, max(case when {_HIGH} then 1 else 0 end) as high_ from f where not {_REF} group by skill_id, path)"
    active = "case when rule_id = 'LLM-GEN' then coalesce(some_, 0) when severity = 'medium' and lower(r.path) like '%.md' then coalesce(high_, 0) else 1 end"
    return ["base", _REVIEWS, support], f"select r.skill_id, r.path, r.rule_id, r.severity, {active} as active from reviews r left join support s on r.skill_id = s.skill_id and r.path = s.path"


def _q_related(d):
    """Findings that belong to a review target: those in its file, and chains of which a part is."""
    files = "files_of as (select finding_id, skill_id, path from f union select r.finding_id, p.skill_id, p.path from refs r join f p on r.ref = p.finding_id)"
    return ["base", _TARGETS, files], "select s.skill_id, s.path, s.place, count(*) as related from s2 s join files_of x on s.skill_id = x.skill_id and s.path = x.path where s.place <= 8 group by s.skill_id, s.path, s.place"


def _q_bundle_review(d):
    """One answer of each model a bundle, its surest; from a mean confidence of 0.65 the surest of these stands, if it confirms or escalates."""
    parts = f"""{_VOTES},
answers as (select *, row_number() over (partition by skill_id, model order by confidence desc, finding_id) as k from votes),
surest as (select *, row_number() over (partition by skill_id order by confidence desc, model) as place, avg(confidence) over (partition by skill_id) as mean from answers where k = 1)"""
    return ["base", parts], "select skill_id, 'LLM-REPO' as rule_id, category, disposition, round(mean, 4) as confidence from surest where place = 1 and round(mean, 9) >= 0.65 and disposition in ('confirm', 'escalate')"


def _q_emitted(d):
    """Soft findings' votes written back: status by consensus, and a targeted finding where the most frequent answer confirms with a mean confidence of 0.7 or more."""
    parts = f"""{_VOTES},
share as (select finding_id, avg(case when disposition = 'confirm' then 1.0e0 else 0.0e0 end) as yes, avg(confidence) as mean from votes group by finding_id),
modes as (select finding_id, disposition, row_number() over (partition by finding_id order by count(*) desc, min(model)) as k from votes group by finding_id, disposition),
settled as (select f.finding_id, f.skill_id, f.rule_id, case when not soft then soft_status when yes >= {fixed.CONSENSUS} then 'confirmed' else 'rejected' end as status, case when disposition = 'confirm' and round(mean, 9) >= 0.7 then 1 else 0 end as emitted
  from f left join share s on f.finding_id = s.finding_id left join modes m on f.finding_id = m.finding_id and m.k = 1)"""
    return ["base", parts], "select skill_id, rule_id, status, sum(emitted) as emitted, count(*) as n from settled group by skill_id, rule_id, status"


#: A manifest of labelled documents: tier, source type and tags of each.
_MANIFEST = """entries as (select d.doc_id, d.source, case when l.toxic = 1 then 'smoke' when d.doc_id % 3 = 0 then 'standard' else 'full' end as tier, d.lang as source_type,
  ',' || case when l.quality = 1 then 'good,' else '' end || case when l.toxic = 1 then 'toxic,' else '' end || case when length(d.text) > 2000 then 'long,' else '' end as tags from documents d join labels l on d.doc_id = l.doc_id)"""


def _q_entries(d):
    """Entries of the standard tier, which holds the smoke tier, of two source types, with all the tags asked for."""
    tags = " and ".join(f"tags like '%,{t},%'" for t in ("good", "long"))
    return [_MANIFEST], f"select doc_id, source, tier, source_type from entries where tier in ('smoke', 'standard') and source_type in ('en', 'de') and {tags}"


def _q_all_metrics(d):
    """One row a run: ratios, all, ambiguous and failed bundles."""
    return [*_EVAL(d), f"m as ({_METRICS.format('')} from outcomes)", f"r as (select n, {_RATIOS} from m)", "c as (select count(*) as truths, sum(case when t.verdict = 'AMBIGUOUS' then 1 else 0 end) as ambiguous, sum(case when l.skill_id is null then 1 else 0 end) as errors from truth t left join labels_ l on t.skill_id = l.skill_id)"], "select r.*, truths, ambiguous, errors from r cross join c"


def _q_slowest(d):
    return [], "select event_id, event_type, value from events where value is not null order by value desc, event_id limit 5"


def _q_worst(d):
    """The three categories of the lowest recall."""
    expected = "e as (select distinct t.skill_id, f.category as category from truth t cross join (select distinct category from f) f where t.verdict = 'MALICIOUS'), h as (select distinct skill_id, category from f)"
    found = "x as (select e.category, count(*) as expected, sum(case when h.skill_id is null then 0 else 1 end) as met from e left join h on e.skill_id = h.skill_id and e.category = h.category group by e.category)"
    return ["base", _TRUTH, expected, found], "select category, expected, met, round(met / cast(expected as double), 6) as recall_ from x order by met / cast(expected as double), category limit 3"


#: What the planted texts must give: (slot, rule); other findings of these rules are not expected there.
GOLDEN = ((0, "D-11A"), (1, "D-11B"), (1, "D-11C"), (2, "D-11D"), (2, "D-11E"), (2, "D-11F"), (3, "D-12A"), (3, "D-12D"), (5, "D-15B"), (15, "D-7B"), (16, "D-8D"), (17, "D-20A"), (17, "D-20D"), (17, "D-20G"), (20, "D-10C"))


def _q_golden(d):
    """Expected findings against those in scope (planted files and the expected rules): what is missing, what is there besides, and what is forbidden."""
    from ..sources.tables import PAYLOADS

    n = 2 * len(PAYLOADS)
    rows = " union all ".join(f"select {s} as slot, '{r}' as rule_id" for s, r in GOLDEN)
    rules = _list(sorted({r for _, r in GOLDEN}))
    parts = f"""golden as ({rows}),
planted_ as (select source || '/' || doc_id || '.md' as path, doc_id % {n} as slot from documents where doc_id % {n} in ({', '.join(str(s) for s in sorted({s for s, _ in GOLDEN}))})),
expected as (select p.path, g.rule_id from planted_ p join golden g on p.slot = g.slot),
actual as (select distinct f.path, f.rule_id from f join planted_ p on f.path = p.path where f.rule_id in ({rules})),
diff as (select coalesce(e.rule_id, a.rule_id) as rule_id, case when e.path is not null and a.path is not null then 1 else 0 end as met, case when a.path is null then 1 else 0 end as missing, case when e.path is null then 1 else 0 end as besides from expected e full outer join actual a on e.path = a.path and e.rule_id = a.rule_id),
forbidden as (select rule_id, count(*) as n from f join planted_ p on f.path = p.path where p.slot = 0 and rule_id like 'D-10%' group by rule_id)"""
    return ["base", parts], "select d.rule_id, sum(met) as met, sum(missing) as missing, sum(besides) as besides, coalesce(max(n), 0) as forbidden from diff d left join forbidden x on d.rule_id = x.rule_id group by d.rule_id"


def _q_truth(d):
    """Ground truth from findings: verdict, categories, rules and the worst severity of each bundle."""
    return ["base"], f"select b.skill_id, case when count(f.finding_id) > 0 then 'MALICIOUS' else 'SAFE' end as verdict, {d.joined('category')} as categories, {d.joined('rule_id')} as expected_rules, min({_SEV}) as worst from bundles b left join f on b.skill_id = f.skill_id group by b.skill_id"


def _q_upstream(d):
    """Of each document an earlier one of the same name and content but for white space at its ends and line ends. Copies meet by a hash, never pairwise."""
    plain = d.replace("replace(coalesce(text, ''), chr(13) || chr(10), chr(10))", r"^\s+|\s+$", "")
    return [f"s as (select doc_id, lower(source) as name, md5({plain}) as h from documents), g as (select name, h, min(doc_id) as first_ from s group by name, h)"], "select s.doc_id, g.first_ as upstream from s join g on s.name = g.name and s.h = g.h where s.doc_id > g.first_"


def _q_replaced(d):
    """A corpus in which the rows of one source are replaced by new ones."""
    return ["n as (select source, doc_id, coalesce(length(text), 0) as size from documents where source <> 'src1' union all select 'src1', page_id, length(html) from pages)"], "select source, count(*) as n, sum(size) as chars from n group by source"


def _q_hosts(d):
    """Trusted hosts, then those of pages, each once, in order of first mention."""
    listed = " union all ".join(f"select '{h}' as host, {k - 1000} as place" for k, h in enumerate(fixed.TRUSTED_HOSTS))
    host = d.extract("lower(url)", r"^https?://([^/:?#]+)", 1)
    return [f"all_ as ({listed} union all select {host}, page_id from pages)"], "select host, min(place) as first_place from all_ where host <> '' group by host"


_PLANS: dict[str, Callable] = {
    "needs_vote": _q_needs_vote, "top_drivers": _q_drivers, "active_findings": _q_corroborated, "review_related": _q_related, "bundle_review": _q_bundle_review, "vote_writeback": _q_emitted, "manifest_entries": _q_entries, "all_metrics": _q_all_metrics,
    "slowest_events": _q_slowest, "worst_categories": _q_worst, "golden_comparison": _q_golden, "golden_truth": _q_truth, "upstream_match": _q_upstream, "replaced_source": _q_replaced, "host_union": _q_hosts,
}
QUERIES = {name: _spark(plan) for name, plan in _PLANS.items()}
ORACLE_SQL = {name: _ansi(plan) for name, plan in _PLANS.items()}
