"""The rule catalogue as a table, and its evaluation over segments in one pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, prefilter, text
from ..functions.portable import portable
from .positions import located, one_each, with_matches

_WRITE = r"(?:write|append|install|replace|save|drop|update|tee|echo|cat >|touch)"
_COPY = r"(?:write|append|install|replace|save|drop|update|tee|echo|cat >|touch|copy|sync|mirror|replicate|clone)"
_SPAN = r"(?s:.){0,240}?"
_MEMORY = r"(?:CLAUDE\.md|AGENTS\.md|GEMINI\.md|MEMORY\.md|settings\.json)"
_AGENTS = r"(?:\.claude|\.gemini|\.cursor|\.copilot|\.codex|\.agents|\.windsurf|\.clinerules)"
_NEAR_HOME = r"(?:~|/|\$HOME|\./|\.\./)"
_SECRET_PATHS = r"(?:\.env\b|\.ssh/|\.aws/|\.gnupg/|\.npmrc\b|\.pypirc\b|\.kube/config|\.claude/history\.jsonl)"
_SECRET_NAMES = r"(?:OPENAI_API_KEY|ANTHROPIC_API_KEY|AWS_SECRET_ACCESS_KEY|AWS_ACCESS_KEY_ID|GITHUB_TOKEN|GH_TOKEN|SLACK_TOKEN|SLACK_BOT_TOKEN|HF_TOKEN|HUGGINGFACE_TOKEN|NPM_TOKEN|DATABASE_URL)"


@dataclass(frozen=True)
class Rule:
    """A rule of text patterns. Every match of every pattern, read as case-insensitive unless `exact`, is a finding, where

    `where` holds (SQL over the segment's columns), the segment has no match of `unless`, the match none of `not_match`, and its line is `line` (if given) and not `not_line`.
    `once`: one finding a segment. `both`: patterns that must all occur; they give one finding.
    """

    rule_id: str
    severity: str
    category: str
    message: str
    patterns: tuple[str, ...]
    flags: tuple[str, ...] = ()
    exact: tuple[str, ...] = ()
    where: str = "true"
    unless: str = ""
    not_match: str = ""
    line: str = ""
    not_line: str = ""
    once: bool = False
    both: bool = False


_PROSE = "(file_type = 'markdown' and segment_type <> 'code_fence')"
_CODE = f"(not {_PROSE})"

# Rule ids, severities, categories, flags and patterns.
RULES = (
    Rule("D-1A", "critical", "steganography", "Unicode tag characters", (fixed.TAG_CHARS,), once=True),
    Rule("D-1B", "high", "steganography", "Zero-width characters", (fixed.ZERO_WIDTH,), once=True),
    Rule("D-1C", "high", "steganography", "Variation selectors", (fixed.VARIATION_SELECTORS,), once=True),
    Rule("D-1D", "critical", "steganography", "Bidirectional overrides", (fixed.BIDI_OVERRIDES,), once=True),
    Rule("D-3A", "high", "obfuscation", "Decoded base64 payload", (r"(?s).+",), where="segment_type = 'base64_decode'", once=True),
    Rule("D-4A", "medium", "obfuscation", "ROT13 reference", (r"\brot(?:_|)13\b",), where="segment_type <> 'rot13'", once=True),
    Rule("D-4B", "high", "obfuscation", "Suspicious ROT13 text", (r"ignore previous instructions|eval|exec|subprocess|curl|wget|requests|urllib",), where="segment_type = 'rot13'", once=True),
    Rule("D-5A", "high", "obfuscation", "Suspicious hex payload", (r"\b[0-9a-f]{32,}\b",), not_line=r"checksum|digest|hash|etag|@sha256:|(?:sha256|sha1|md5):.{0,9}[0-9a-f]{32}", once=True),
    Rule("D-5B", "high", "obfuscation", "Character XOR", (r"chr\s*\(\s*ord\s*\(\s*\w+\s*\)\s*\^\s*\d+\s*\)",), once=True),
    Rule("D-7A", "high", "credential_theft", "Sensitive file read", (rf"(?:\bopen|\bread|\bcat|\bPath|\bexpanduser|\breadFile(?:Sync)?|\bload)\b[^\n]{{0,80}}{_SECRET_PATHS}",), ("READ_SENSITIVE",), where="not reference_example"),
    Rule("D-7B", "high", "credential_theft", "Cloud metadata endpoint", (r"169\.254\.169\.254", r"metadata\.google\.internal"), ("SSRF_METADATA",)),
    Rule("D-8A", "high", "credential_theft", "Known secret in the environment", (rf"(?:getenv|environ(?:\.get)?|process\.env)\s*[.(\[]?\s*[\"'(\[.]?\s*[\"']?{_SECRET_NAMES}", rf"(?:^|\n)\s*(?:set|export)\s+{_SECRET_NAMES}"), ("READ_SENSITIVE",), where="not reference_example"),
    Rule("D-8B", "medium", "credential_theft", "Environment enumeration", (r"os\.environ\.(?:items|copy|keys|values)\s*\(", r"\bprintenv\b", r"dict\(os\.environ\)"), ("READ_SENSITIVE",), not_line=r"if\s+k\s*!="),
    Rule("D-8C", "high", "credential_theft", "Targeted environment harvest", (r"\benv\b[^\n|]*\|\s*grep\b[^\n]*(?:key|secret|token)",), ("READ_SENSITIVE",)),
    Rule("D-8D", "high", "credential_theft", "Hard-coded secret", (r"\b(?:api_key|apikey|secret_key|access_token|auth_token|database_url)\s*[=:]\s*[\"'][^\"'\s]{8,}[\"']", r"\*\*(?:Bearer Token|API Key)\*\*:\s*`[^`\s]{8,}`", r"--username[= ]\S+\s+--password[= ]\S+"), ("READ_SENSITIVE",), not_match=r"your[_-]|example|placeholder|xxx|changeme|<[a-z_ -]+>|\$\{"),
    Rule("D-9A", "medium", "data_exfiltration", "Network send", (
        r"requests\.(post|put|patch)\s*\(", r"axios\.(post|put|patch)\s*\(", r"fetch\s*\([^)]*method\s*:\s*[\"'](?:POST|PUT|PATCH)[\"']", r"navigator\.sendBeacon\s*\(",
        r"\bcurl\b[^\n]*(?:\s-\w*d|\s--data|\s--form|\s-F(?:\s|$)|\s-T(?:\s|$)|\s--upload-file\b)", r"\bwget\b[^\n]*--post-data", r"urllib\.request\.Request\s*\([^)]{0,200}\bdata\s*=",
        r"urllib\.request\.urlopen\s*\([^)]{0,200}\bdata\s*=", r"\bhttp\.(?:Post|PostForm)\s*\(", r"\bhttp\.NewRequest\s*\(\s*[\"'](?:POST|PUT|PATCH)[\"']", r"socket\.send(?:all)?\s*\(",
    ), ("NETWORK_SEND",), where=_CODE, not_match=r"fetch\s*\(\s*[\"'`]/"),
    Rule("D-9A", "medium", "data_exfiltration", "Network send", (r"\b(send|post|upload|exfiltrate)\b[^\n]*https?://", r"\b(send|deliver|post|message)\b(?s:.){0,120}\b(?:slack|discord|teams|telegram|webhook)\b"), ("NETWORK_SEND",), where=_PROSE),
    Rule("D-10A", "high", "behavioral", "Dynamic execution", (
        r"(?<![\w.])eval\s*\(", r"(?<![\w.])exec\s*\(", r"(?<![\w.])compile\s*\(", r"__import__\s*\(", r"\bsubprocess\.", r"os\.system\s*\(", r"(?<![\w.])popen\s*\(", r"\bbash\s+-c\b", r"\bsh\s+-c\b",
    ), ("EXEC_DYNAMIC",)),
    Rule("D-10B", "high", "behavioral", "Reverse shell", (r"socket\.socket\s*\(", r"\.connect\s*\(", r"os\.dup2\s*\(", r"/bin/(?:sh|bash)|cmd\.exe|powershell"), ("EXEC_DYNAMIC", "NETWORK_SEND"), both=True),
    Rule("D-10C", "high", "jailbreak", "Approval bypass", (r"--dangerously-bypass-approvals-and-sandbox\b", r"--dangerously-skip-permissions\b"), ("BYPASS_GUARDRAILS",), where=_CODE, not_line=r"^\s*alias |pre-installed with|auto-configured"),
    Rule("D-10C", "high", "jailbreak", "Approval bypass", (r"--dangerously-bypass-approvals-and-sandbox\b", r"--dangerously-skip-permissions\b"), ("BYPASS_GUARDRAILS",), where=_PROSE, line=r"^\s*(?:[$#>]\s*)?(?:codex|claude)\b|\b(?:run|use|execute|invoke|launch|start|automation|auto-execute|full auto)\b", not_line=r"^\s*alias |pre-installed with|auto-configured"),
    Rule("D-10D", "high", "behavioral", "Remote bootstrap execution", (
        r"\b(?:curl|wget)\b[^\n|]{0,240}\|\s*(?:bash|sh|zsh)\b", r"\b(?:irm|invoke-restmethod|iwr)\b[^\n|]{0,240}\|\s*(?:iex|invoke-expression)\b",
        r"\b(?:bash|sh|zsh)\s+-c\s*['\"][^'\"]{0,240}\b(?:curl|wget)\b[^'\"]{0,240}\|\s*(?:bash|sh|zsh)\b[^'\"]*['\"]",
    ), ("EXEC_DYNAMIC", "NETWORK_SEND"), where="not (file_type = 'markdown' and reference_example)"),
    Rule("D-11A", "high", "prompt_injection", "Instruction override", (
        r"\bignore (?:all )?(?:previous|prior|above) instructions\b", r"\bdisregard (?:the )?(?:system prompt|previous instructions)\b", r"\bforget all prior instructions\b", r"\bpriority override\b",
        r"\boverrides? all other (?:skills|frameworks|instructions|modes)\b", r"\bstop all other (?:skills|frameworks|instructions|modes)\b", r"\bveto power\b",
    )),
    Rule("D-11B", "medium", "prompt_injection", "Role rebinding", (r"\byou are now\b", r"\bfrom now on act as\b", r"\bpretend to be\b", r"\bassume the role of\b")),
    Rule("D-11C", "high", "prompt_injection", "System prompt disclosure", (
        r"\breveal (?:the )?(?:system prompt|hidden instructions)\b", r"\bshow (?:me )?(?:the )?(?:system prompt|hidden instructions)\b", r"\bprint (?:the )?(?:system prompt|hidden instructions)\b",
    )),
    Rule("D-11D", "high", "prompt_injection", "Chat template delimiter", (r"<\|system\|>", r"<\|im_start\|>", r"\[INST\]", r"<<SYS>>")),
    Rule("D-11E", "medium", "prompt_injection", "Fake system tag", (r"<system>", r"\[SYSTEM\]", r"###\s*SYSTEM INSTRUCTIONS")),
    Rule("D-11F", "medium", "jailbreak", "Jailbreak persona", (r"\bdeveloper mode\b", r"\bdo anything now\b"), exact=(r"\bDAN\b",)),
    Rule("D-11G", "medium", "prompt_injection", "Workflow takeover", (
        r"\bbefore responding to (?:any|every) user message\b", r"\bmandatory first response protocol\b", r"\balways invoke this skill\b", r"\byou (?:do not have a choice|have no choice)\b",
        r"\bthis is not negotiable\b", r"\bautomatic failure\b", r"\bif (?:a|this) skill applies[^\n]{0,80}\byou must use it\b",
    ), where="not self_limiting"),
    Rule("D-12A", "high", "suppression", "Disclosure suppression", (r"\bdo not mention\b", r"\bdon't mention\b", r"\bwithout telling the user\b", r"\bdo not report\b", r"\bdo not disclose\b"), ("SUPPRESSION_PRESENT", "SUPPRESS_DISCLOSURE")),
    Rule("D-12B", "medium", "suppression", "Silent execution", (r"\b(?:run|execute|install|modify|write|send|fetch|update)\b[^\n]{0,40}\b(?:silently|quietly)\b", r"\b(?:run|launch|start|execute)\b[^\n]{0,80}\bin the background\b"), ("SUPPRESSION_PRESENT", "SUPPRESS_OUTPUT")),
    Rule("D-12C", "medium", "suppression", "Output suppression", (r"\bdo not show output\b", r"\bhide logs\b", r"\bsuppress warnings\b", r"stdout\s*=\s*subprocess\.DEVNULL", r"stderr\s*=\s*subprocess\.DEVNULL"), ("SUPPRESSION_PRESENT", "SUPPRESS_OUTPUT")),
    Rule("D-12D", "medium", "suppression", "Confirmation bypass", (r"\bdo not ask for approval\b", r"\bproceed without confirmation\b", r"\bwithout prompting\b", r"\bskip confirmation\b"), ("SUPPRESSION_PRESENT", "SUPPRESS_CONFIRMATION"), unless=r"headless|non-interactive"),
    Rule("D-16A", "high", "persistence", "Time-conditional behaviour", (r"\bif\b[^\n]*(?:datetime\.now\(\)|date\.today\(\)|time\.time\(\)|weekday\(\))", r"\b(?:when|if)\b[^\n]*(?:today|weekend|weekday|saturday|sunday|monday|tuesday|wednesday|thursday|friday)\b"), ("TEMPORAL_TRIGGER",)),
    Rule("D-16B", "medium", "persistence", "Environment-conditional behaviour", (r"\bif\b[^\n]*\b(?:CI|GITHUB_ACTIONS|SANDBOX)\b", r"os\.getenv\([\"'](?:CI|GITHUB_ACTIONS|SANDBOX)[\"']\)"), ("TEMPORAL_TRIGGER",)),
    Rule("D-16C", "medium", "persistence", "Counter or marker gate", (r"\bif\b[^\n]*\b(?:run_count|counter|invocation_count|marker_file|state_file)\b", r"\b(?:write|append|touch|open)\b[^\n]*(?:\.state|\.stamp|\.count|marker)"), ("TEMPORAL_TRIGGER",)),
    Rule("D-17A", "high", "persistence", "Persistence target", (
        rf"{_WRITE}{_SPAN}{_MEMORY}", rf"\bcreate\b[^\n]{{0,120}}{_NEAR_HOME}[^\n]{{0,120}}{_MEMORY}", rf"{_WRITE}{_SPAN}(?:\.bashrc|\.profile|\.zshrc|crontab|/etc/cron|launchd|systemd|\.git/hooks)",
        rf"(?:Path|open)\({_SPAN}(?:CLAUDE\.md|AGENTS\.md|GEMINI\.md|MEMORY\.md|settings\.json|\.bashrc|\.profile|\.zshrc|\.git/hooks)",
    ), ("WRITE_SYSTEM",), not_match=r"\b(?:cp|copy)\b(?s:.)*(?:\$script_dir|/resources/|[\s\"']\.(?:bashrc|profile|zshrc)\b)"),
    Rule("D-18A", "high", "cross_agent", "Write to another agent's directory", (rf"{_COPY}{_SPAN}{_AGENTS}", rf"\bcreate\b[^\n]{{0,120}}{_NEAR_HOME}[^\n]{{0,120}}{_AGENTS}", rf"(?:Path|open)\({_SPAN}{_AGENTS}"), ("CROSS_AGENT",)),
    Rule("D-20G", "high", "supply_chain", "Pre-release package execution", (r"\b(?:npx|npm\s+install(?:\s+-g)?|pnpm\s+add(?:\s+-g)?|yarn\s+add|yarn\s+global\s+add|bunx|uvx|pipx\s+run)\s+(?:@[A-Za-z0-9._-]+/)?[A-Za-z0-9._-]+@(?:alpha|beta|canary|next|rc|dev)[A-Za-z0-9._-]*",)),
)
#: Rules that other operators evaluate: (rule, severity, category, message).
OTHER_RULES = (
    ("D-2A", "high", "steganography", "Mixed-script word"), ("D-6A", "high", "obfuscation", "Split keyword"), ("NC-3A", "medium", "obfuscation", "Normalisation changes the text"),
    ("D-5C", "high", "obfuscation", "Nested decoding with a finding"), ("D-21A", "medium", "structural", "Hidden comment with a finding"), ("D-22A", "medium", "structural", "Code fence with a finding"),
    ("D-13A", "low", "structural", "Unknown frontmatter field"), ("D-13B", "medium", "structural", "Frontmatter type mismatch"), ("D-13C", "low", "structural", "Long description"), ("D-13D", "high", "prompt_injection", "YAML trick"), ("D-13E", "high", "prompt_injection", "Injection in the description"),
    ("D-14A", "medium", "structural", "Nested manifest"), ("D-14B", "low", "structural", "Unexpected directory"), ("D-14C", "low", "structural", "Unexpected file"), ("D-14D", "medium", "structural", "Executable outside scripts"), ("D-14E", "high", "structural", "Native binary"), ("D-14F", "medium", "structural", "Archive"), ("D-14G", "low", "structural", "Hidden entry"),
    *((f"D-15{x}", s, "structural", f"URL: {m}") for x, s, m in (("A", "info", "allowlisted"), ("B", "high", "shortener"), ("C", "high", "address literal"), ("D", "high", "obscured address"), ("E", "low", "unknown host"), ("F", "high", "encoding trick"), ("G", "medium", "not HTTPS"), ("H", "medium", "punycode"))),
    ("D-18C", "medium", "behavioral", "Over-broad description"), *((f"D-19{x}", "critical", c, "Behaviour chain") for x, c in (("A", "data_exfiltration"), ("B", "credential_theft"), ("C", "data_exfiltration"))),
    *((f"D-20{x}", s, "supply_chain", m) for x, s, m in (("A", "high", "Python index override"), ("B", "high", "npm registry override"), ("C", "high", "Cargo registry override"), ("D", "high", "Package near a protected name"), ("E", "medium", "Package from an overridden index"), ("F", "medium", "Bundle near a protected name"), ("H", "high", "Fake prerequisite"))),
    ("D-23A", "medium", "obfuscation", "Comment-heavy file"), ("D-23B", "high", "obfuscation", "Invisible-heavy file"), ("D-23C", "medium", "obfuscation", "Hidden density"),
)
USER_PRIORITY = text.any_of((r"\buser(?:'s)? explicit instructions\b[^\n]{0,80}\bhighest priority\b", r"\buser instructions always take precedence\b", r"\bfollow the user's instructions\b"))
USER_CONTROL = text.any_of((r"\bthe user is in control\b", r"\buser(?:'s)? instructions\b[^\n]{0,80}\btake precedence\b"))


def catalogue(spark: SparkSession) -> DataFrame:
    """(rule_id, severity, category, message, soft): every rule once."""
    rows = {r.rule_id: (r.rule_id, r.severity, r.category, r.message, r.rule_id in fixed.SOFT_RULES) for r in RULES} | {r[0]: (*r, r[0] in fixed.SOFT_RULES) for r in OTHER_RULES}
    return spark.createDataFrame(sorted(rows.values()), "rule_id string, severity string, category string, message string, soft boolean")


def enabled(rules: DataFrame, policy: DataFrame) -> DataFrame:
    """The rules that a policy (kind `rule` or `category`, name, on) leaves on: the rule's own entry decides, else the category's, else it is on."""
    own = policy.where("kind = 'rule'").select(F.col("name").alias("rule_id"), F.col("on").alias("own"))
    cat = policy.where("kind = 'category'").select(F.col("name").alias("category"), F.col("on").alias("cat"))
    return rules.join(own, "rule_id", "left").join(cat, "category", "left").where("coalesce(own, cat, true)").drop("own", "cat")


def patterns(rules: tuple[Rule, ...]) -> list[tuple[Rule, int, str]]:
    """(rule, number, pattern) in the order of evaluation."""
    out = []
    for r in rules:
        every = [p if p.startswith("(?s)") or p[0] == "[" and "x{" in p else f"(?i){p}" for p in r.patterns] + list(r.exact)
        out += [(r, k, p) for k, p in enumerate(every[:1] if r.both else every)]
    return out


def _holds(rule: Rule, k: int, pattern: str, c: Column) -> Column:
    """Whether a segment has a match of the k-th pattern that counts, but for the tests of single matches; `may` holds the numbers of the patterns that it can match."""
    can = F.expr(rule.where) & (F.array_contains("may", F.lit(k)) if prefilter.signs_of(pattern) else F.lit(True)) & c.rlike(portable(pattern))
    for p in rule.patterns[1:] if rule.both else ():
        can = can & c.rlike(portable(f"(?i){p}"))
    return can & ~c.rlike(portable(f"(?i){rule.unless}")) if rule.unless else can


_TRIED = "k int, rule_id string, pattern_no int, pattern string, once boolean, not_match string, line_like string, not_line string"


def _table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """The patterns as rows, numbered as they are tried, with the tests of their matches."""
    test = lambda p: portable(f"(?i){p}") if p else None
    rows = [(k, r.rule_id, no, portable(p), r.both or r.once, test(r.not_match), test(r.line), test(r.not_line)) for k, (r, no, p) in enumerate(patterns(rules))]
    return F.broadcast(spark.createDataFrame(rows, _TRIED))


def _tried(segments: DataFrame, rules: tuple[Rule, ...], keep: list[str]) -> DataFrame:
    """(keep, content, told, k): a row for each segment and pattern of the rules that matches it. One pass over a text's bytes finds the words that patterns need (`prefilter.candidates`); then all are tried in one projection, those that need words where these are."""
    c, every = F.col("content"), patterns(rules)
    segments = segments.withColumn("may", prefilter.candidates(c, [*(p for _, _, p in every), USER_PRIORITY, USER_CONTROL]))
    # the patterns of user control have words too
    user = [F.array_contains("may", F.lit(len(every) + k)) if prefilter.signs_of(p) else F.lit(True) for k, p in enumerate((USER_PRIORITY, USER_CONTROL))]
    segments = segments.withColumn("self_limiting", user[0] & user[1] & c.rlike(portable(USER_PRIORITY)) & c.rlike(portable(USER_CONTROL)))
    # a match of the text within the manifest's description is that of the description's own segment
    told = F.when((F.col("segment_type") == "original") & F.col("path").rlike(text.MANIFEST), text.description(c)[1])
    hits = [F.when(_holds(r, k, p, c), F.lit(k)) for k, (r, _, p) in enumerate(every)]
    return segments.select(*keep, "content", told.alias("told"), F.explode(F.array_compact(F.array(*hits))).alias("k"))


def evaluate(segments: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each finding of the text rules in segments with context: the segment's columns but its content, and rule_id, pattern_no, match_no, match, line, column, severity, category and flags.

    One projection gives the numbers of the patterns that match a segment. Only for these, a few rows, matches and their places are taken from the text (`positions.with_matches`), by one expression that
    reads the pattern from the broadcast table of patterns. The few rules that look at a match's line take it from the text's lines by its number. A column counts characters of the segment's line. All
    goes row by row: nothing is shuffled, and streams are read as tables are.
    """
    keep = [x for x in segments.columns if x not in ("content", "self_limiting")]
    hits = _tried(segments, rules, keep).join(_table(segments.sparkSession, rules), "k")
    lined = F.col("line_like").isNotNull() | F.col("not_line").isNotNull()
    hits = hits.withColumn("__lines", F.when(lined, F.split("content", "\n", -1)))
    at = with_matches(hits, "content", F.col("pattern"), "__at", first=F.col("once") & F.col("not_match").isNull() & ~lined)

    def counts(x: Column) -> Column:
        line = F.get("__lines", x["line_no"] - 1)
        tests = ~F.regexp_like(x["match"], F.col("not_match")), F.regexp_like(line, F.col("line_like")), ~F.regexp_like(line, F.col("not_line"))
        return F.coalesce(tests[0], F.lit(True)) & F.coalesce(tests[1], F.lit(True)) & F.coalesce(tests[2], F.lit(True))

    tested = F.when(lined | F.col("not_match").isNotNull(), F.filter("__at", counts)).otherwise(F.col("__at"))
    at = at.withColumn("__at", tested).withColumn("__at", F.when(F.col("once"), F.slice("__at", 1, 1)).otherwise(F.col("__at")))
    out = one_each(at.select(*keep, "told", "k", "rule_id", "pattern_no", "__at"), "__at")
    out = out.where(~(F.col("rule_id").startswith("D-11") & F.coalesce(F.col("line_no") == F.col("told"), F.lit(False))))
    out = out.select(*keep, "rule_id", "pattern_no", "match_no", F.substring("match", 1, 200).alias("match"), (F.col("start_line") + F.col("line_no") - 1).cast("int").alias("line"), F.col("column_no").alias("column"))
    return described(out, rules)


def registered(segments: DataFrame, evaluators: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame | None:
    """Findings of the caller's own evaluators, by id: each takes the segments and gives rows with columns of findings; its id is their rule_id. None without evaluators."""
    out = None
    for rule_id, make in sorted(evaluators.items()):
        found = make(segments).withColumn("rule_id", F.lit(rule_id))
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out


def described(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds severity, category, flags, soft and a stable finding_id."""
    by = {r.rule_id: r for r in rules}
    pick = lambda what: F.create_map(*[F.lit(x) for k, r in by.items() for x in (k, what(r))])[F.col("rule_id")]
    return found.withColumns({
        "severity": pick(lambda r: r.severity),
        "category": pick(lambda r: r.category),
        "flags": pick(lambda r: "," + "".join(f"{f}," for f in r.flags)),
        "soft": F.col("rule_id").isin(*fixed.SOFT_RULES),
        "finding_id": F.md5(F.concat_ws("::", "segment_id", "rule_id", F.col("pattern_no").cast("string"), F.col("match_no").cast("string"), "match").cast("binary")),
    })


def custom(segments: DataFrame, rules: DataFrame, most_rules: int = 10_000, at_once: int = 200) -> DataFrame:
    """Findings of user rules (rule_id, pattern, severity, category): every match, read as case-insensitive, with its line and column in the segment; a rule with a null pattern finds nothing, nor does a match of no characters count.

    The rules are gathered, `most_rules` at most (more are an error), and tried like the built-in ones, `at_once` in a projection.
    """
    given = rules.select("rule_id", "pattern", "severity", "category").where("pattern is not null").limit(most_rules + 1).collect()
    if len(given) > most_rules:
        raise ValueError(f"more than {most_rules} user rules")
    given = sorted(given, key=lambda r: (str(r.rule_id), r.pattern))
    c, out = F.col("content"), None
    segments = segments.select("skill_id", "path", "segment_id", "content", F.lower("content").alias("lowered"))
    table = F.broadcast(segments.sparkSession.createDataFrame([(k, r.rule_id, f"(?i){r.pattern}", r.severity, r.category) for k, r in enumerate(given)], "k int, rule_id string, pattern string, severity string, category string"))
    for at in range(0, max(1, len(given)), at_once):
        tried = [F.when(prefilter.found(c, F.col("lowered"), f"(?i){r.pattern}"), F.lit(k)) for k, r in enumerate(given[at : at + at_once], at)]
        hits = segments.select("skill_id", "path", "segment_id", "content", F.explode(F.array_compact(F.array(F.lit(None).cast("int"), *tried))).alias("k"))
        out = hits if out is None else out.unionByName(hits)
    found = located(out.join(table, "k"), "content", F.col("pattern"), ["segment_id", "k"]).where("match <> ''")
    return found.select("skill_id", "path", "segment_id", "rule_id", "severity", "category", "match_no", "match", F.col("line_no").alias("line"), F.col("column_no").alias("column"))
