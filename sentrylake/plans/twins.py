"""The scan as one ANSI SQL statement, for comparison with the DataFrame operators: same rules, patterns and fixed values."""

from __future__ import annotations

from ..functions import fixed, text
from ..operators import postrules, rules, segments, supply
from ..sources.tables import PAYLOADS
from .dialect import Ansi as D

#: Begins patterns that must not follow a word character or a dot.
NOT_AFTER = r"(?<![\w.])"
_NL = "(length({0}) - length(replace({0}, chr(10), '')))"


def _lines(x: str) -> str:
    return _NL.format(f"({x})")


def artifacts() -> str:
    rows = ", ".join(f"({k}, {D.text(p)})" for k, p in enumerate(PAYLOADS))
    return f"""payloads(slot, payload) as (values {rows}),
artifacts as (select source as skill_id, source || '/' || doc_id || '.md' as path, 'markdown' as file_type, coalesce(text || coalesce(chr(10) || payload, ''), '') as content
  from documents left join payloads on doc_id % {2 * len(PAYLOADS)} = slot)"""


def pages() -> str:
    return "artifacts as (select 'page' || page_id as skill_id, 'page' || page_id || '/page.md' as path, 'markdown' as file_type, coalesce(html, '') as content from pages)"


def _before(pattern: str) -> str:
    p, f = f"string_split_regex(content, {D.text(pattern)})", D.found("content", pattern)
    return _lines(f"array_to_string(({p})[1:i + 1], '') || array_to_string(({f})[1:i], '')")


def _children(parents: str, g: int) -> str:
    """The g-th generation: the parts of the texts of `parents`, as `g{g}`."""
    both, three = segments.FENCE_OR_COMMENT, segments.FENCE_COMMENT_OR_CODE
    keep = "skill_id, path, file_type, segment_id as parent_id, list_append(ancestors, segment_id) as ancestors, key, chain"
    child = "substr(sha256(parent_id || '::' || segment_type || '::' || ordinal), 1, 16) as segment_id"
    return f"""up{g} as materialized (select * from {parents} where file_type = 'markdown' and segment_type in ('original', 'html_comment', 'code_fence')),
fences{g} as (select {keep}, 'code_fence' as segment_type, i as ordinal, ({D.found('content', segments.FENCE, 2)})[i + 1] as body, start_line + {_before(segments.FENCE)} + 1 as line, lower(trim(({D.found('content', segments.FENCE, 1)})[i + 1])) as language
  from (select *, unnest(range(len({D.found('content', segments.FENCE)}))) as i from up{g})),
comments{g} as (select {keep}, 'html_comment' as segment_type, 1000000000 + i as ordinal, substr(x, 5, length(x) - 7) as body, start_line + {_before(both)} as line, '' as language
  from (select *, ({D.found('content', both)})[i + 1] as x from (select *, unnest(range(len({D.found('content', both)}))) as i from up{g})) where starts_with(x, '<!--')),
codes{g} as (select {keep}, 'base64_decode' as segment_type, 2000000000 + i as ordinal, try(decode(try(from_base64(x)))) as body, start_line + {_before(three)} as line, '' as language
  from (select *, ({D.found('content', three)})[i + 1] as x from (select *, unnest(range(len({D.found('content', three)}))) as i from up{g}))
  where {D.like('x', segments.BASE64)} and length(x) % 4 = 0 and length(x) <= {segments.MOST_CHARS * 4 // 3}),
rotated{g} as (select {keep}, 'rot13' as segment_type, 3000000000 as ordinal, translate(content, '{segments.ROT13[0]}', '{segments.ROT13[1]}') as body, start_line as line, '' as language from up{g} where {D.like('content', '(?i)rot_?13')}),
parts{g} as (select * from fences{g} union all select * from comments{g} union all (select * from codes{g} where length(body) > 0 qualify row_number() over (partition by parent_id order by ordinal) <= {segments.MOST_DECODED}) union all select * from rotated{g}),
g{g} as materialized (select skill_id, path, file_type, {child}, segment_type, body as content, line as start_line, language, parent_id, {g} as depth, ancestors, list_append(key, ordinal) as key, list_append(chain, segment_type) as chain from parts{g})"""


def _segments() -> str:
    """Files and three generations of children; of a file's children the first in document order."""
    names = "skill_id, path, file_type, segment_id, segment_type, content, start_line, language, parent_id, depth, ancestors, chain"
    return f"""originals as materialized (select skill_id, path, file_type, substr(sha256(path || '::original'), 1, 16) as segment_id, 'original' as segment_type, content, 1 as start_line, '' as language, null::varchar as parent_id, 0 as depth, []::varchar[] as ancestors, []::bigint[] as key, ['original'] as chain from artifacts),
{_children("originals", 1)},
{_children("g1", 2)},
{_children("g2", 3)},
segs as materialized (select {names} from originals
  union all select {names} from (select * from g1 union all select * from g2 union all select * from g3) qualify row_number() over (partition by path order by key) <= {segments.MOST_SEGMENTS})"""


def _context() -> str:
    hints = lambda names: " or ".join(f"contains(lower('/' || path), {D.text(x)})" for x in names)
    languages = ", ".join(map(D.text, fixed.EXECUTABLE_LANGUAGES))
    return f"""ctx as materialized (select *,
    case when file_type <> 'markdown' then 'code' when segment_type = 'code_fence' and language in ({languages}) then 'executable_snippet'
      when {D.like('content', text.word_of(fixed.ACTIONABLE_VERBS))} or {D.like('content', text.heading_of(fixed.ACTIONABLE_HEADINGS))} then 'actionable_instruction' else 'documentation' end as context,
    case when file_type = 'markdown' then 'markdown' else 'code' end as source_kind,
    ({hints(fixed.REFERENCE_PATHS)}) or (file_type = 'markdown' and {D.like('content', text.any_of(fixed.REFERENCE_PATTERNS))}) as reference_example,
    ({hints(fixed.BOOTSTRAP_PATHS)}) or {D.like('content', text.any_of(fixed.BOOTSTRAP_PATTERNS))} as bootstrap,
    {D.like('content', rules.USER_PRIORITY)} and {D.like('content', rules.USER_CONTROL)} as self_limiting
  from segs)"""


_KEEP = "skill_id, path, segment_id, segment_type, parent_id, start_line, context, source_kind, reference_example, bootstrap"


def _hits() -> str:
    parts = []
    for k, (r, no, p) in enumerate(rules.patterns(rules.RULES)):
        number, tests = "i", []
        if p.startswith(f"(?i){NOT_AFTER}"):  # this engine can't look behind: the character before is taken along, and such matches are left out
            p = "(?i)[\\w.]?" + p[len(f"(?i){NOT_AFTER}") :]
            tests.append(f"not {D.like('match', '(?i)^[\\w.](?:eval|exec|compile|popen)')}")
            number = "row_number() over (partition by segment_id order by i) - 1"
        can = [D.like("content", p), f"({r.where})"] + [D.like("content", f"(?i){x}") for x in (r.patterns[1:] if r.both else ())]
        if r.unless:
            can.append(f"not {D.like('content', f'(?i){r.unless}')}")
        only = "[1:1]" if r.both or (r.once and not r.not_line) else ""
        for pattern, col, wanted in ((r.not_match, "match", "not "), (r.line, "line_text", ""), (r.not_line, "line_text", "not ")):
            if pattern:
                tests.append(wanted + D.like(col, f"(?i){pattern}"))
        parts.append(
            f"select {_KEEP}, '{r.rule_id}' as rule_id, {no} as pattern_no, {number} as match_no, match, line_no, column_no from (select *, string_split(content, chr(10))[line_no] as line_text from ("
            f"select *, f[i + 1] as match, 1 + {_lines("array_to_string(p[1:i + 1], '') || array_to_string(f[1:i], '')")} + case when starts_with(f[i + 1], chr(10)) then 1 else 0 end as line_no, "
            "case when starts_with(f[i + 1], chr(10)) then 1 else 1 + length(string_split(substr(content, 1, length(array_to_string(p[1:i + 1], '') || array_to_string(f[1:i], ''))), chr(10))[-1]) end as column_no from ("
            f"select *, unnest(range(len(f))) as i from (select *, ({D.found('content', p)}){only} as f, string_split_regex(content, {D.text(p)}) as p from ctx where {' and '.join(can)}))))"
            + (f" where {' and '.join(tests)}" if tests else "")
        )
    once = ", ".join(f"'{r.rule_id}'" for r in rules.RULES if r.once and r.not_line)
    by = {r.rule_id: r for r in rules.RULES}
    pick = lambda what: "case rule_id " + " ".join(f"when '{k}' then '{what(r)}'" for k, r in by.items()) + " end"
    return "raw as (" + "\nunion all ".join(parts) + f"""),
hits as materialized (select skill_id, path, segment_id, segment_type, parent_id, rule_id, pattern_no, match_no, substr(match, 1, 200) as match, start_line + line_no - 1 as line, column_no, context, source_kind, reference_example, bootstrap,
    {pick(lambda r: r.severity)} as severity, {pick(lambda r: r.category)} as category, {pick(lambda r: ',' + ''.join(f + ',' for f in r.flags))} as flags,
    md5(segment_id || '::' || rule_id || '::' || pattern_no || '::' || match_no || '::' || substr(match, 1, 200)) as finding_id
  from raw qualify rule_id not in ({once}) or row_number() over (partition by segment_id, rule_id order by pattern_no, match_no) = 1)"""


def mixed(col: str) -> str:
    latin, cyrillic, greek, wide = (D.like(col, s) for s in text.SCRIPTS)
    return f"(({latin} and ({cyrillic} or {greek} or {wide})) or ({wide} and ({cyrillic} or {greek})))"


def _folded(col: str) -> str:
    for _, p in text.REMOVALS:
        col = D.replace(col, p, "")
    fold = f"array_to_string(list_transform(regexp_extract_all({col}, '\\s+|\\S+', 0), lambda t: case when {mixed('t')} then translate(t, '{fixed.LOOK_ALIKES}', '{fixed.LOOKS_LIKE}') else t end), '')"
    return f"case when {mixed(col)} then {fold} else {col} end"


def _normal() -> str:
    """Texts before each keyword is put together (n0, n1, ...) and after all (normal)."""
    steps, now = [f"n0 as (select {_KEEP}, content, {_folded('content')} as t from ctx where segment_type = 'original')"], "n0"
    logs = []
    for k, w in enumerate(fixed.SPLIT_KEYWORDS):
        p = text.split_keyword(w)
        logs.append(f"select {_KEEP}, {k} as k, unnest(range(len({D.found('t', p)}))) as j, unnest({D.found('t', p)}) as m, {D.text(w)} as w from {now}")
        new = "t"
        for _ in range(3 if w[0] == w[-1] else 1):
            new = D.replace(new, p, w)
        steps.append(f"n{k + 1} as materialized (select * exclude (t), {new} as t from {now})")
        now = f"n{k + 1}"
    return ",\n".join(steps) + f""",
normal as (select * from {now}),
splits as ({' union all '.join(logs)}),
d6 as (select *, row_number() over (partition by segment_id order by k, j) - 1 as no, w || ' ' || m as match from splits),
d2 as (select {_KEEP}, unnest(range(len(ws))) as no, unnest(ws) as match from (select *, list_filter(string_split_regex(content, '\\s+'), lambda t: {mixed('t')} and not {D.like('t', text.CJK)}) as ws from ctx where {mixed('content')}))"""


def _other(rule_id: str, source: str, no: str, match: str, line: str = "start_line") -> str:
    _, severity, category, _ = next(r for r in rules.OTHER_RULES if r[0] == rule_id)
    return f"select skill_id, path, segment_id, segment_type, parent_id, '{rule_id}' as rule_id, 0 as pattern_no, {no} as match_no, {match} as match, {line} as line, context, source_kind, reference_example, bootstrap, '{severity}' as severity, '{category}' as category, ',' as flags, md5(segment_id || '::{rule_id}::' || {no} || '::' || {match}) as finding_id from {source}"


def _nearest(k: int) -> str:
    """Order among combinations of equal points: those in one file, by path and last line, each part nearest to it; else by paths, lines and ids."""
    x = "abc"[:k]
    one = " and ".join(f"path_{y} = path_a" for y in x[1:])
    last = "greatest(" + ", ".join(f"line_{y}" for y in x) + ")"
    each = ", ".join(f"case when {one} then '' else path_{y} end, case when {one} then -line_{y} else line_{y} end, part_{y}" for y in x)
    return f"not ({one}), case when {one} then path_a else '' end, case when {one} then {last} else 0 end, {each}"


def product(policy: tuple) -> str:
    """Chains of three flags by comparing all their findings: a CTE `chained`."""
    rows = ", ".join("(" + ", ".join(f"'{v}'" for v in c) + ")" for c in policy)
    every = lambda what: " and ".join(f"({what.format(x)})" for x in "abc")
    some = lambda what: " or ".join(f"({what.format(x)})" for x in "abc")
    md, same = every("{0}.source_kind = 'markdown'"), "a.path = b.path and b.path = c.path"
    least, most = (f"{f}(a.line, b.line, c.line)" for f in ("least", "greatest"))
    acts = some("{0}.context in ('actionable_instruction', 'executable_snippet')")
    between = f"regexp_matches(array_to_string(string_split(g.content, chr(10))[{least} - g.start_line + 2 : {most} - g.start_line], chr(10)), '(?m)^[ \\t]{{0,3}}#{{1,6}}[ \\t]+[^ \\t\\n]')"
    points = [
        (same, 1), (f"{same} and {most} - {least} <= 3", 3), (f"{same} and {most} - {least} between 4 and 15", 2), (f"{same} and {most} - {least} between 16 and 60", 1), (f"{md} and {same} and {most} - {least} > 3", -3), (f"not ({md})", 2), (acts, 1), (f"{md} and not ({acts})", -2),
        (every("{0}.reference_example"), -3), (every("{0}.segment_type in ('code_fence', 'html_comment')"), -2), (f"{md} and a.segment_id = b.segment_id and b.segment_id = c.segment_id and {between}", -2),
        (some("contains(lower({0}.path), '/references/') or lower({0}.path) like '%/readme.md' or lower({0}.path) like '%/license.txt'"), -1),
    ]
    score = " + ".join(f"(case when {c} then {v} else 0 end)" for c, v in points)
    named = ", ".join(f"{x}.finding_id as part_{x}, {x}.path as path_{x}, {x}.line as line_{x}" for x in "abc")
    joins = " ".join(f"join found {x} on contains({x}.flags, ',' || p.flag_{x} || ',')" + (f" and {x}.skill_id = a.skill_id" if x != "a" else "") for x in "abc")
    return f"""long_policy(chain, rule_id, category, flag_a, flag_b, flag_c) as (values {rows}),
triples as (select p.chain, a.skill_id, {named}, {score} as score from long_policy p {joins} left join ctx g on g.segment_id = a.segment_id
  where a.finding_id <> b.finding_id and b.finding_id <> c.finding_id and a.finding_id <> c.finding_id),
chained as (select skill_id, chain, score, concat_ws(',', part_a, part_b, part_c) as parts, concat_ws(',', path_a, path_b, path_c) as paths
  from (select * from triples qualify row_number() over (partition by skill_id, chain order by score desc, {_nearest(3)}) = 1))"""


def _post() -> str:
    supports = "(category in ('prompt_injection', 'obfuscation', 'suppression') or rule_id in ('D-10A', 'D-17A') or starts_with(rule_id, 'D-19'))"
    a, b = "a.", "b."
    both_md = f"({a}source_kind = 'markdown' and {b}source_kind = 'markdown')"
    acts = f"({a}context in ('actionable_instruction', 'executable_snippet') or {b}context in ('actionable_instruction', 'executable_snippet'))"
    same, span = f"{a}path = {b}path", f"abs({a}line - {b}line)"
    # lines of the segment strictly between the two findings, of which one is a heading
    between = f"regexp_matches(array_to_string(string_split(g.content, chr(10))[least({a}line, {b}line) - g.start_line + 2 : greatest({a}line, {b}line) - g.start_line], chr(10)), '(?m)^[ \\t]{{0,3}}#{{1,6}}[ \\t]+[^ \\t\\n]')"
    hint = f"(contains(lower({a}path || ' ' || {b}path), '/references/') or regexp_matches(lower({a}path || ' ' || {b}path), '/readme[.]md(?: |$)|/license[.]txt(?: |$)'))"
    points = [
        (f"{a}path = {b}path", 1), (f"{same} and {span} <= 3", 3), (f"{same} and {span} between 4 and 15", 2), (f"{same} and {span} between 16 and 60", 1), (f"{both_md} and {same} and {span} > 3", -3), (f"({a}source_kind <> 'markdown' or {b}source_kind <> 'markdown')", 2),
        (acts, 1), (f"{both_md} and not {acts}", -2), (f"{a}reference_example and {b}reference_example", -3), (f"{a}segment_type in ('code_fence', 'html_comment') and {b}segment_type in ('code_fence', 'html_comment')", -2), (f"{both_md} and {a}segment_id = {b}segment_id and {between}", -2), (hint, -1),
    ]
    score = " + ".join(f"(case when {c} then {v} else 0 end)" for c, v in points)
    policy = ", ".join("(" + ", ".join(f"'{x}'" for x in c) + ")" for c in postrules.CHAINS)
    parts, more = supply.found(D)
    supplied = f"select x.skill_id, x.path, x.segment_id, x.segment_type, c.parent_id, rule_id, 0 as pattern_no, 0 as match_no, match, line, x.context, x.source_kind, x.reference_example, x.bootstrap, severity, category, ',' as flags, md5(x.segment_id || '::' || rule_id || '::0::' || match) as finding_id from ({more}) x join (select segment_id, parent_id from ctx) c using (segment_id)"
    return ",\n".join(parts) + f""",
first_ as materialized (select * exclude (column_no) from hits union all {_other('D-2A', 'd2', 'no', 'match')} union all {_other('D-6A', 'd6', 'no', 'match')}
  union all {_other('NC-3A', "(select * from normal where t <> content)", '0', "''")} union all {supplied}),
reach as (select finding_id, {supports} as s, segment_id from first_ union all select finding_id, {supports}, unnest(ancestors) from first_ join (select segment_id, ancestors from segs) using (segment_id)),
under as (select segment_id, list_sort(list(distinct finding_id) filter (s)) as strong from reach group by segment_id),
hidden as (select ctx.*, strong from ctx join under using (segment_id) where segment_type in ('html_comment', 'code_fence') and len(strong) > 0),
found as materialized (select * exclude (parent_id, pattern_no, match_no, match), null::varchar[] as refs from first_
  union all select * exclude (parent_id, pattern_no, match_no, match, strong), strong from (select x.*, strong from ({_other('D-21A', "(select * from hidden where segment_type = 'html_comment')", '0', "''")}) x join hidden using (segment_id))
  union all select * exclude (parent_id, pattern_no, match_no, match, strong), strong from (select x.*, strong from ({_other('D-22A', "(select * from hidden where segment_type = 'code_fence')", '0', "''")}) x join hidden using (segment_id))),
chain_policy(chain, rule_id, category, flag_a, flag_b) as (values {policy}),
pairs as (select c.chain, c.rule_id, c.category, a.skill_id, a.finding_id as part_a, b.finding_id as part_b, a.path as path_a, b.path as path_b, a.line as line_a, b.line as line_b, {score} as score, {both_md} as md, {both_md} and {a}reference_example and {b}reference_example as only_refs
  from chain_policy c join found a on contains(a.flags, ',' || c.flag_a || ',') join found b on contains(b.flags, ',' || c.flag_b || ',') and a.skill_id = b.skill_id and a.finding_id <> b.finding_id left join ctx g on g.segment_id = a.segment_id),
linked as materialized (select *, case when md then 'high' else 'critical' end as severity from (select * from pairs qualify row_number() over (partition by skill_id, chain order by score desc, {_nearest(2)}) = 1) where score >= 2 and not only_refs),
everything as materialized (select finding_id, skill_id, path, segment_id, segment_type, rule_id, severity, category, flags, line, context, source_kind, reference_example, bootstrap, refs from found
  union all select md5(skill_id || '::' || rule_id), skill_id, skill_id || '/SKILL.md', null, 'original', rule_id, severity, category, ',', 1, null, null, false, false, [part_a, part_b] from linked)"""


def scan(source: str | None = None, upto: str = "everything") -> str:
    """The common table expressions up to the named one: segs, ctx, hits, normal or everything."""
    parts = [source or artifacts(), _segments(), _context(), _hits(), _normal(), _post()]
    return "with " + ",\n".join(parts[: {"segs": 2, "ctx": 3, "hits": 4, "normal": 5, "everything": 6}[upto]]) + "\n"


def scan_without_hits() -> str:
    return "with " + ",\n".join([artifacts(), _segments(), _context(), _normal()]) + "\n"
