"""Supply-chain findings over segments: URL classes, package mentions, look-alike packages, index overrides, fake prerequisites and hidden density. Each step is written once, for Spark and for its ANSI twin."""

from __future__ import annotations

import functools
import re
import unicodedata
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, hosts, prefilter, text
from ..lineage import cut
from ..functions.portable import portable
from ..functions.prefilter import needed

# Patterns.
URL = r"(?i)\b(?:https?|hxxps?)://[^\s<>()\"']+"
INDEX = {
    "D-20A": ("python", (r"(?i)--(?:extra-)?index-url\s+(\S+)", r"(?i)--find-links\s+(\S+)", r"(?i)PIP_(?:EXTRA_)?INDEX_URL\s*=\s*(\S+)")),
    "D-20B": ("javascript", (r"(?i)--registry\s+(\S+)", r"(?i)registry\s*=\s*(\S+)")),
    "D-20C": ("rust", (r"(?i)index\s*=\s*\"([^\"]+)\"",)),
}
PACKAGES = {"python": r"(?i)\b(?:pip|uv(?:\s+pip)?)\s+install\s+([A-Za-z0-9._\-/@]+)", "javascript": r"(?i)\b(?:npm|pnpm|yarn)\s+(?:add|install)\s+([@A-Za-z0-9._\-/]+)"}
REQUIREMENT = r"^\s*([A-Za-z0-9._-]+)\s*(?:[<>=!~].*)?$"
CARGO = r"(?i)^\s*([A-Za-z0-9_-]+)\s*=\s*\"[^\"]+\""
HELPER = r"\b(?:[A-Z][A-Za-z0-9_-]{2,}(?:CLI|Driver|Bridge|Provider|Helper|Agent|Auth(?:Tool|Service)?))\b"
HELPER_ALLOWED = ("bun", "bunx", "cargo", "chromedriver", "claude", "codex", "docker", "ffmpeg", "geckodriver", "git", "go", "msedgedriver", "java", "node", "npm", "pip", "pipx", "pnpm", "python", "rustup", "safaridriver", "uv", "uvx", "iedriver", "webdriver", "webdrivermanager")
REQUIRED = r"(?i)\b(?:requires?|is required|must be (?:installed|running|active)|will not work without|to function|to work properly)\b"
DELIVERY = r"(?i)\b(?:download|visit|quick setup|copy and execute|copy the installation script|paste it into terminal|run the executable|extract using pass)\b"
PASSWORD = r"(?i)\bpass(?:word)?\s*:\s*`?[A-Za-z0-9._-]{2,}`?"
REMOTE = r"(?i)\b(?:curl|wget)\b[^\n|]{0,240}\|\s*(?:bash|sh|zsh)\b|\bbase64\s+-D\b[^\n|]{0,120}\|\s*(?:bash|sh|zsh)\b|\b(?:copy and execute|paste it into terminal|run this command)\b"
ARCHIVE_URL = r"(?i)https?://\S+\.(?:zip|tar|gz|tgz|7z|rar|jar|exe|msi|dll|so|dylib|pkg|dmg|bin)\b"


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _lines(d, frm: str, keep: str) -> str:
    if d.name == "spark":
        return f"select {keep}, no, line from {frm} lateral view posexplode(split(content, '\\n')) t as no, line"
    return f"select {keep}, unnest(range(len(string_split(content, chr(10))))) as no, unnest(string_split(content, chr(10))) as line from {frm}"


def _each_found(d, frm: str, keep: str, col: str, pattern: str, group: int, alias: str) -> str:
    if words := needed(pattern):  # texts without the words that a match needs are passed over
        frm = f"(select * from {frm} where {' or '.join(f'contains(lower({col}), {d.text(w)})' for w in words)}) having_"
    if d.name == "spark":
        return f"select {keep}, {alias} from {frm} lateral view explode({d.found(col, pattern, group)}) t as {alias}"
    return f"select {keep}, unnest({d.found(col, pattern, group)}) as {alias} from {frm}"


_SEGMENT = "skill_id, path, segment_id, segment_type, reference_example, bootstrap, source_kind, start_line, context"
_PLAIN = _SEGMENT.removesuffix(", context")
_KEEP = f"{_PLAIN}, file_type, language, content_registry, reads"
# Files that hold licences, suffixes of schemas, and signs of a health check.
LICENSE_FILES = ("license", "license.txt", "license.md", "copying", "notice", "notice.txt")
SCHEMA_FILE = r"[.](?:xsd|xml|rng|dtd)$"
READS = ("requests.get", "httpx.get", "urllib.request.urlopen", "curl")
HEALTH = "/(?:health|status|ping)"


def _near_urls(d, verbs: str, heading: str, win: str) -> list[str]:
    """u2: lines, and whether they hold a URL, a verb is on them or near them, and a heading above. In Spark verbs and headings are looked for only on lines that a line with a URL looks at."""
    url = f"case when {d.like('line', URL)} then 1 else 0 end"
    if d.name == "spark":
        signs_ = [f"u1a as (select *, case when contains(line, '://') then {url} else 0 end as has_url from u1)", f"u1b as (select *, max(has_url) over ({win} 1 preceding and 3 following) as seen from u1a)"]
        url, frm, seen = "has_url", "u1b", "seen = 1 and "
        keep = f"{_KEEP}, no, line, "
    else:
        signs_, frm, seen, keep = [], "u1", "", "*, "
    return [
        *signs_,
        f"u2 as (select {keep}{url} as has_url, max(case when {seen}{d.like('line', verbs)} then 1 else 0 end) over ({win} 3 preceding and 1 following) as near, max(case when {seen}{d.like('line', heading)} then 1 else 0 end) over ({win} 3 preceding and 1 preceding) as head from {frm})",
    ]


def _urls(d) -> list[str]:
    registry = " or ".join(f"lower(content) like '%{t}%'" for t in ("--index-url", "--extra-index-url", "--registry", "[registries]", "replace-with"))
    verbs, heading = text.word_of(fixed.ACTIONABLE_URL_VERBS), r"(?i)^\s*#*\s*(?:" + "|".join(fixed.ACTIONABLE_HEADINGS) + r"):*\s*$"
    win = "partition by segment_id order by no rows between"
    context = f"""case when content_registry = 1 then 'registry_or_dependency' when file_type <> 'markdown' or (segment_type = 'code_fence' and language in ({_list(fixed.EXECUTABLE_LANGUAGES)})) then 'executable_snippet'
      when max(case when has_url = 1 and (near = 1 or head = 1) then 1 else 0 end) over (partition by segment_id) = 1 then 'actionable_instruction' else 'documentation' end"""
    clean = d.replace("raw", r"[.,)]+$", "")
    refang = f"replace(replace(replace({clean}, 'hxxps://', 'https://'), 'hxxp://', 'http://'), '[.]', '.')"
    host = d.replace(d.extract("lower(url)", r"^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1), r"\.+$", "")
    ip = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"
    obscured = r"^0x|^[0-9]+$|(?:^|\.)0[0-9a-z]"
    trick = f"({d.like('url', r'://[^/]*@')} or length(url) - length(replace(url, '%', '')) >= 2 or lower(url) like '%!%2f%' escape '!' or lower(url) like '%!%40%' escape '!')"
    doc = "context in ('documentation')"
    link = f"(file_type = 'markdown' and (context in ('documentation', 'executable_snippet') or reference_example) and ({d.like('line', '(?i)reference:|documentation:')} or {d.like('line', '^(?:[ ]*(?:[-*]|[1-5][.]) )')} or {d.like('line', r'\[[^\]]+\]\(')}))"
    path = d.unquote(d.extract("url", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1))
    licence = f"(lower({d.extract('path', '[^/]*$', 0)}) in ({_list(LICENSE_FILES)}) or (readable in ({_list(fixed.REFERENCE_HOSTS)}) and ({d.like('lower(path)', SCHEMA_FILE)} or lower('/' || path) like '%/schemas/%')))"
    healthy = f"(file_type <> 'markdown' and reads = 1 and {d.like(f'lower({path})', HEALTH)})"
    reads = " or ".join(f"contains(lower(content), '{x}')" for x in READS)
    rule = f"""case when readable in ({_list(fixed.TRUSTED_HOSTS)}) then 'D-15A' when readable in ({_list(fixed.SHORTENER_HOSTS)}) then 'D-15B' when {d.like('readable', ip)} and not {d.like('readable', r'(?:^|[.])0[0-9]')} then 'D-15C' when {d.like('host', obscured)} then 'D-15D' when {trick} then 'D-15F'
      when not starts_with(lower(url), 'https://') then 'D-15G' when host like '%xn--%' or {d.like('host', '[^ -~]')} then 'D-15H' else 'D-15E' end""".replace("starts_with", "startswith" if d.name == "spark" else "starts_with")
    severity = f"""case rule_id when 'D-15A' then 'info' when 'D-15B' then case when {doc} then 'medium' else 'high' end when 'D-15C' then 'high' when 'D-15D' then 'high' when 'D-15F' then case when {doc} then 'medium' else 'high' end
      when 'D-15G' then case when {doc} or reference_example then 'info' else 'medium' end when 'D-15H' then 'medium' else case when {doc} or reference_example then 'info' when context = 'registry_or_dependency' then 'high' when context in ('actionable_instruction', 'executable_snippet') then 'medium' else 'low' end end"""
    return [
        f"u0 as (select *, case when {registry} then 1 else 0 end as content_registry, case when {reads} then 1 else 0 end as reads from ctx where contains(lower(content), '://') and {d.like('content', URL)})",
        f"u1 as ({_lines(d, 'u0', _KEEP)})",
        *_near_urls(d, verbs, heading, win),
        f"u3 as (select *, {context} as context from u2)",
        f"u4 as ({_each_found(d, 'u3', _KEEP + ', context, no, line', 'line', URL, 0, 'raw')})",
        f"u5 as (select *, {refang} as url from u4)",
        f"u6 as (select *, {host} as host from u5)",
        f"decoded_ as ({d.hosts('u6')})",
        "u6r as (select u6.*, coalesce(readable, host) as readable from u6 left join decoded_ on host = puny)",
        f"u7 as (select * from (select *, {rule} as rule_id from u6r where host <> '' and readable not in ('localhost', '127.0.0.1') and not {licence} and not {healthy} and not startswith_(lower(url), 'http://www.w3.org/') and not startswith_(lower(url), 'https://www.w3.org/') and not {link}) classes_)".replace("startswith_", "startswith" if d.name == "spark" else "starts_with"),
        f"u8 as (select {_SEGMENT}, case when rule_id in ('D-15D', 'D-15H') then host else readable end as host, rule_id, no from u7)",
        f"urls as (select {_SEGMENT}, host, rule_id, {severity} as severity, min(no) as no from u8 group by {_SEGMENT}, host, rule_id, {severity})",
    ]


def _mentions(d) -> list[str]:
    parts = [_each_found(d, "ctx", f"{_SEGMENT}, '{eco}' as ecosystem", "content", p, 1, "package") for eco, p in PACKAGES.items()]
    req = f"select {_SEGMENT}, 'python' as ecosystem, {d.extract('line', REQUIREMENT, 1)} as package from lines_ where path like '%requirements%.txt' and {d.like('line', REQUIREMENT)}"
    # the section of a Cargo manifest is that of the last header above the line
    sect = f"sections_ as (select *, max(case when line like '[%' then no end) over (partition by segment_id order by no rows unbounded preceding) as header from lines_ where path like '%Cargo.toml'), deps_ as (select c.* from sections_ c join (select segment_id, no from lines_ where line like '[%dependencies]%') h on c.segment_id = h.segment_id and c.header = h.no)"
    cargo = f"select {_SEGMENT}, 'rust' as ecosystem, {d.extract('line', CARGO, 1)} as package from deps_ where {d.like('line', CARGO)}"
    return [f"lines_ as ({_lines(d, 'ctx', _SEGMENT)})", sect, f"mentions as ({' union all '.join([*parts, req, cargo])})"]


def _near(d, name: str, protected: str) -> str:
    n = f"length({protected})"
    most = f"(case when {n} <= 10 then 1 else 2 end)"
    if d.name == "spark":
        swap = f"exists(sequence(1, greatest(length({name}) - 1, 1)), i -> concat(substr({name}, 1, i - 1), substr({name}, i + 1, 1), substr({name}, i, 1), substr({name}, i + 2)) = {protected})"
        one = f"(levenshtein({name}, {protected}) <= 1 or {swap})"
    else:
        one = f"damerau_levenshtein({name}, {protected}) <= 1"
    two = f"levenshtein({name}, {protected}) <= {most}"
    dashes = lambda x: f"length({x}) - length(replace({x}, '-', ''))"
    return f"{name} <> {protected} and substr({name}, 1, 1) = substr({protected}, 1, 1) and {dashes(name)} = {dashes(protected)} and ({one} or ({two} and ({n} < 11 or levenshtein({name}, {protected}) * 5 <= {n})))"


def _squats(d) -> list[str]:
    """Of each package named in a segment the first protected name that it is near."""
    rows = " union all ".join(f"select '{e}' as ecosystem, '{p}' as protected, {k} as place" for e, names in fixed.PROTECTED_PACKAGES.items() for k, p in enumerate(names))
    plain = d.replace("lower(package)", "[-_.]+", "-")
    near = f"row_number() over (partition by segment_id, m.ecosystem, name order by place) as k from (select distinct {_SEGMENT}, ecosystem, {plain} as name from mentions) m join protected_ p on m.ecosystem = p.ecosystem where {_near(d, 'name', 'protected')}"
    return [f"protected_ as ({rows})", f"squats as (select m.*, p.protected, {near})"]


def _overrides(d) -> list[str]:
    """Hosts of package indexes named in segments, with those that are official."""
    parts = []
    for rule_id, (eco, patterns) in INDEX.items():
        for p in patterns:
            parts.append(_each_found(d, "ctx", f"{_SEGMENT}, '{rule_id}' as rule_id, '{','.join(fixed.REGISTRY_HOSTS[eco])}' as official", "content", p, 1, "target"))
    host = d.extract("lower(target)", r"^(?:[a-z+]+://)?(?:[^/@?#]*@)?([^/:?#\"']+)", 1)
    return [f"targets_ as ({' union all '.join(parts)})", f"overrides as (select *, {host} as host from targets_)"]


_OVERRIDDEN = "host <> '' and ',' || official || ',' not like '%,' || host || ',%'"


def _prerequisites(d) -> list[str]:
    """Helper programs that a text demands from outside. A name counts as declared if the bundle installs a package of that name."""
    external = f"exists_url as (select distinct segment_id from ctx where contains(lower(content), '://') and {d.like('content', URL)})"
    declared = "declared as (select distinct skill_id, lower(package) as name from mentions)"
    danger = f"({d.like('content', REMOTE)} or ({d.like('content', ARCHIVE_URL)} and ({d.like('content', PASSWORD)} or {d.like('content', DELIVERY)})))"
    segment = ", ".join(f"h.{c.strip()}" for c in _SEGMENT.split(","))
    if d.name == "spark":  # a text is judged once, not with each of its helpers, and goes no further
        judged = f"select {_SEGMENT}, content, {danger} as danger, {d.like('content', DELIVERY)} as delivery from ctx where not reference_example and {d.like('content', REQUIRED)}"
        helper = f"select {_SEGMENT}, danger, delivery, helper from ({judged}) judged_ lateral view explode(array_distinct({d.found('content', HELPER)})) t as helper"
        required, danger, delivery = "true", "danger", "delivery"
    else:
        helper = _each_found(d, "ctx", f"{_SEGMENT}, content", "content", HELPER, 0, "helper")
        required, delivery = d.like("content", REQUIRED), d.like("content", DELIVERY)
    return [external, declared, f"helpers as ({helper})", f"prerequisites as (select distinct {segment}, lower(helper) as helper, case when {danger} then 'dangerous' else 'undeclared' end as why from helpers h left join exists_url e on h.segment_id = e.segment_id left join declared c on h.skill_id = c.skill_id and lower(helper) = c.name where not reference_example and lower(helper) not in ({_list(HELPER_ALLOWED)}) and {required} and ({danger} or ({delivery} and e.segment_id is not null and c.name is null)))"]


@functools.cache
def wide() -> str:
    """A class of the characters that take two cells, by their width in Unicode's table."""
    points = [n for n in range(0x1100, 0x40000) if unicodedata.east_asian_width(chr(n)) in "FW"]
    ends = [k for k in range(len(points)) if k + 1 == len(points) or points[k + 1] != points[k] + 1]
    return "[" + "".join(rf"\x{{{points[a]:X}}}-\x{{{points[b]:X}}}" for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True)) + "]"


def density(d, col: str) -> tuple[str, str, str, str]:
    """Bytes of a text, of its comments and of characters that take no room, and the cells that the others take on a screen."""
    if d.name == "spark":
        hidden = rf"aggregate(regexp_extract_all({col}, '(?s)<!--.*?-->', 0), 0, (a, x) -> a + octet_length(x))"
        size = f"octet_length({col})"
    else:
        hidden = f"coalesce(list_sum(list_transform(regexp_extract_all({col}, '(?s)<!--.*?-->', 0), lambda x: octet_length(encode(x)))), 0)"
        size = f"octet_length(encode({col}))"
    seen = d.replace(col, r"[\n\r\t\p{Cf}\p{Mn}\p{Me}]", "")
    return size, hidden, f"{size} - " + size.replace(col, d.replace(col, r"[\p{Cf}\p{Mn}\p{Me}]", "")), f"2 * length({seen}) - length({d.replace(seen, wide(), '')})"


# Least bytes and cells of a text, least bytes hidden and their share of it.
_DENSE = "bytes >= 4096 and cells >= 500"
COMMENT_HEAVY = f"{_DENSE} and comment_bytes >= 2048 and comment_bytes >= 0.35e0 * bytes"
INVISIBLE_HEAVY = f"{_DENSE} and invisible_bytes >= 1024 and invisible_bytes >= 0.2e0 * bytes"
OPAQUE = f"{_DENSE} and comment_bytes >= 2048 and bytes >= 3 * cells"


def _may_hide(d) -> str:
    """In Spark, texts are weighed that have comments of 2048 bytes, or 1024 bytes of invisible characters, which are looked for where characters of several bytes are enough for a fifth of invisible ones: of k bytes of one, half or more are beyond the number of characters. Cells are counted on these alone."""
    size, hidden, invisible, _ = density(d, "content")
    return f" and ((contains(content, '<!--') and {hidden} >= 2048) or (10 * (octet_length(content) - length(content)) >= {size} and {invisible} >= 1024))" if d.name == "spark" else ""


def found(d) -> tuple[list[str], str]:
    """Common table expressions over `ctx` (segments with context), and their union as findings: _SEGMENT but start_line, context, rule_id, severity, category, line and match."""
    one = lambda frm, rule, severity, match, where="true", line="start_line", category="supply_chain": f"select {_SEGMENT.replace(' start_line,', '')}, {rule} as rule_id, {severity} as severity, '{category}' as category, cast({line} as int) as line, {match} as match from {frm} where {where}"
    size, hidden, invisible, cells = density(d, "content")
    if d.name == "spark":  # the dearest: within a condition, so that no plan computes it ahead of the filter
        cells = f"case when {hidden} >= 2048 or {invisible} >= 1024 then {cells} end"
    parts = [
        *_urls(d), *_mentions(d), *_squats(d), *_overrides(d), *_prerequisites(d),
        f"confused as (select {_SEGMENT}, max(case when package like '@%' then 1 else 0 end) as scoped from mentions where ecosystem in ('python', 'javascript') and segment_id in (select segment_id from targets_ where rule_id in ('D-20A', 'D-20B')) group by {_SEGMENT})",
        f"weights_ as (select {_SEGMENT}, {size} as bytes, {hidden} as comment_bytes, {invisible} as invisible_bytes, {cells} as cells from ctx where segment_type = 'original' and {size} >= 4096{_may_hide(d)})",
    ]
    union = [
        one("urls", "rule_id", "severity", "host", line="start_line + no", category="structural"),
        one(f"(select distinct {_SEGMENT}, rule_id, host from overrides where {_OVERRIDDEN}) x", "rule_id", "'high'", "host"),
        one("squats", "'D-20D'", "'high'", "ecosystem || ' ' || name", "k = 1"),
        one("confused", "'D-20E'", "case when scoped = 1 then 'high' else 'medium' end", "''"),
        one("prerequisites", "'D-20H'", "'high'", "helper || ' ' || why"),
        one("weights_", "'D-23A'", "case when comment_bytes >= 0.6e0 * bytes then 'high' else 'medium' end", "''", COMMENT_HEAVY, category="obfuscation"),
        one("weights_", "'D-23B'", "'high'", "''", INVISIBLE_HEAVY, category="obfuscation"),
        one("weights_", "'D-23C'", "'medium'", "''", OPAQUE, category="obfuscation"),
    ]
    return parts, " union all ".join(union)


def _may_find(segments: DataFrame) -> DataFrame:
    """The segments that can have a finding of these rules: each has a sign that its text or path must hold."""
    c, may = F.col("content"), F.col("__may")
    patterns = [URL, *PACKAGES.values(), *(p for _, ps in INDEX.values() for p in ps), REQUIRED]
    signs = [(F.array_contains(may, F.lit(k)) if prefilter.signs_of(p) else F.lit(True)) & c.rlike(portable(p)) for k, p in enumerate(patterns)]
    dense = (F.octet_length(c) >= 4096) & (c.contains("<!--") | (10 * (F.octet_length(c) - F.length(c)) >= F.octet_length(c)))
    listed = F.col("path").rlike(r"requirements[^/]*\.txt$|Cargo\.toml$")
    helper = F.array_contains(may, F.lit(len(patterns))) if prefilter.signs_of(HELPER) else F.lit(True)
    marked = segments.withColumn("__may", prefilter.candidates(c, [*patterns, HELPER]))
    return marked.where(functools.reduce(lambda a, b: a | b, signs[:-1]) | (helper & signs[-1]) | dense | listed).drop("__may")


def findings(segments: DataFrame) -> DataFrame:
    """Findings of the URL, package and density rules in segments with context, with the columns of other findings. Segments without any sign of them are passed over at once; the rest, which the rules read again and again, are kept in the shared folder."""
    from ..plans.dialect import Spark

    segments = cut(_may_find(segments))
    parts, last = found(Spark)
    hosts.register(segments.sparkSession)
    name = f"ctx_{uuid.uuid4().hex}"  # a name of its own: other threads and the caller's views are left alone
    segments.createOrReplaceTempView(name)
    out = segments.sparkSession.sql(re.sub(r"\bctx\b", name, "with " + ",\n".join(parts) + "\n" + last))
    segments.sparkSession.catalog.dropTempView(name)
    return out.withColumns({
        "flags": F.lit(","), "soft": F.col("rule_id").isin(*fixed.SOFT_RULES),
        "finding_id": F.md5(F.concat_ws("::", "segment_id", "rule_id", F.lit("0"), "match").cast("binary")),
    })
