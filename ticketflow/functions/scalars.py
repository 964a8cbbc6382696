"""Column functions over tickets, labels and free text (P1-P31). All are built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabulary of the ticket model.
UNKNOWN = "Unknown"
GENERAL = "General / Unspecified"
GAP = ".OFFERING-GAP"
NO_OFFERING = "OFFERING-000"
RESOLVED_WORDS = ("resolved", "closed", "verified", "cancelled", "canceled", "rejected", "duplicate", "completed", "done", "fixed", "withdrawn", "invalid")
PRIORITY_OF_SEVERITY = {"Critical": "critical", "Major": "high", "Minor": "medium", "Cosmetic": "low"}
SEVERITY_RANK = {"Critical": 4, "Major": 3, "Minor": 2, "Cosmetic": 1}
CLUSTER_KINDS = ("incident", "service_request")
HEDGES = ("closest", "not in the allowed list", "safe bet", "best match available")
EMBEDDING_MARKERS = ("embedding", "sentence-transformers", "sentencetransformer", "tokenizer", "torch", "cuda")
TEAMS = (("Payments", ("pay", "bill", "visa")), ("Infrastructure", ("infra", "net", "gate")), ("Operations", ("op", "transport", "accom", "health", "field")))
DEFAULT_TEAM = "App Support"
ARABIC_DIGITS, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩", "0123456789"
DIACRITICS = "ًٌٍَُِّْـٰ"
ARABIC = r"[؀-ۿ]"
SPACES = r"[\s\p{Z}]+"


def blank_to_null(c: Column) -> Column:
    """Trimmed text; null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


#: What is replaced before a text is hashed: markup, numbers, runs of spaces.
HASHED = ((r"<[^>]+>", " "), (r"\p{Nd}+(\.\p{Nd}+)?", "#"), (SPACES, " "))


def content_hash(title: Column, description: Column) -> Column:
    """Hash of title and description without markup, with numbers replaced and spaces collapsed."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))
    for pattern, to in HASHED:
        text = F.regexp_replace(text, pattern, to)
    return F.substring(F.sha2(F.trim(text), 256), 1, 16)


def embedding_text(title: Column, description: Column, ocr: Column | None = None, classification: Column | None = None) -> Column:
    """The non-empty parts, joined; recognised text is marked, a classification is appended."""
    parts = [F.nullif(title, F.lit("")), F.nullif(description, F.lit(""))]
    if ocr is not None:
        parts.append(F.when(F.coalesce(ocr, F.lit("")) != "", F.concat(F.lit("OCR: "), ocr)))
    text = F.trim(F.concat_ws(" | ", *parts))
    return text if classification is None else F.concat(text, F.coalesce(F.concat(F.lit(" | Classified as: "), classification), F.lit("")))


def local_status(source_status: Column) -> Column:
    """Active or resolved."""
    return F.when(F.lower(F.trim(source_status)).isin(*RESOLVED_WORDS), "resolved").otherwise("active")


def priority_from_severity(priority: Column, severity: Column) -> Column:
    """The given priority, else the severity's."""
    mapped = F.lit("medium")
    for name, value in PRIORITY_OF_SEVERITY.items():
        mapped = F.when(severity == name, value).otherwise(mapped)
    return F.coalesce(F.nullif(priority, F.lit("")), mapped)


def ticket_kind(kind: Column, json_kind: Column | None = None) -> Column:
    """P5: the column, else the classification's field, else incident."""
    return F.coalesce(F.nullif(kind, F.lit("")), *([] if json_kind is None else [F.nullif(json_kind, F.lit(""))]), F.lit("incident"))


def system_of(system: Column) -> Column:
    """Trimmed system, Unknown where blank."""
    return F.coalesce(blank_to_null(system), F.lit(UNKNOWN))


def offering_key(service: Column) -> Column:
    """What stands before the last dot; null without one."""
    return F.when(F.contains(service, F.lit(".")), F.trim(F.regexp_extract(F.trim(service), r"^([\s\S]*)\.[^.]*$", 1)))


def service_key(service: Column) -> Column:
    """What stands before the first dot; '' for blank, abstained and generic services."""
    s = F.coalesce(F.trim(service), F.lit(""))
    head = F.trim(F.substring_index(s, ".", 1))
    return F.when((s == "") | F.endswith(s, F.lit(GAP)) | F.startswith(F.lower(head), F.lit("system/application")) | (head == GENERAL), "").otherwise(head)


def service_core(service: Column, system_pattern: str) -> Column:
    """A service's name without the system's, normalised. `system_pattern` matches the systems' names."""
    c = F.lower(F.regexp_replace(F.coalesce(service, F.lit("")), f"(?i){system_pattern}", " "))
    return F.trim(F.regexp_replace(c, r"[^a-z0-9؀-ۿ]+", " "))


def resolve_system(title: Column, description: Column, names: dict[str, str], topics: Sequence[tuple[str, str, str, str]], aliases: dict[str, Sequence[str]]) -> Column:
    """P10: a system's exact name in the text; else the first topic rule (system, must match, must match, must not match); else the only system with an alias in it; else null."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit(""))))
    hits = {s: F.greatest(*[F.contains(text, F.lit(a)) for a in words]) if len(words) > 1 else F.contains(text, F.lit(words[0])) for s, words in aliases.items()}
    count = sum((h.cast("int") for h in hits.values()), F.lit(0))
    out = F.when(count == 1, F.coalesce(*[F.when(h, F.lit(s)) for s, h in hits.items()]))
    for system, one, two, never in reversed(topics):
        out = F.when(text.rlike(one) & text.rlike(two) & ~text.rlike(never), F.lit(system)).otherwise(out)
    for system, name in reversed(list(names.items())):
        out = F.when(F.contains(text, F.lit(name)), F.lit(system)).otherwise(out)
    return out


def confidence_honesty(service: Column, reasoning: Column, confidence: Column) -> Column:
    """Low for unspecific services and hedging reasons."""
    s, r = F.lower(F.coalesce(service, F.lit(""))), F.lower(F.coalesce(reasoning, F.lit("")))
    unsure = F.contains(s, F.lit("general")) | F.contains(s, F.lit("unspecified")) | F.endswith(F.coalesce(service, F.lit("")), F.lit(GAP))
    for h in HEDGES:
        unsure = unsure | F.contains(r, F.lit(h))
    return F.when(unsure, "low").otherwise(confidence)


def normalize_code(c: Column) -> Column:
    """ASCII digits, no separators, upper case."""
    return F.upper(F.translate(c, ARABIC_DIGITS + " \t\r\n-_", ASCII_DIGITS))


def normalize_page(c: Column) -> Column:
    """P14 and one Arabic spelling, without the leading article."""
    c = F.translate(c, "أإآٱةى" + DIACRITICS, "اااا" + "هي")
    return F.regexp_replace(normalize_code(c), "^ال", "")


# Labels and patterns of personal data, with what replaces them, in this order.
PII_DOCUMENT = r"(رقم\s*(?:الهوية|الإقامة|الاقامة|الجواز)|الهوية\s*الوطنية|جواز\s*السفر|national\s*id|iqama|residence\s*(?:id|permit|number)|passport(?:\s*(?:no|number))?)"
PII_NAME = r"(الاسم(?:\s*(?:الثلاثي|الرباعي|الأول|الكامل))?|اسم\s*(?:المستفيد|العميل)?|full\s*name|customer\s*name|beneficiary\s*name|name)"
PII_STOP = r"(?:رقم|الهوية|الإقامة|الاقامة|الجواز|جواز|الاسم|اسم|البريد|هاتف|عنوان|جوال|name|phone|email|address|passport|iqama|national|dob|date|mobile)"
PII_WORD = r"[؀-ۿA-Za-z]+"
PII = (
    (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "[EMAIL]"),
    (r"(?<!\d)(?:(?:\+?966[\s\-]*)?0?5\d{8}|\+\d[\d\s\-()]{7,15}\d)(?!\d)", "[PHONE]"),
    (PII_DOCUMENT + r"\s*[:：]?\s*([A-Za-z0-9][A-Za-z0-9\-]{1,40})", "$1 [DOC-ID]"),
    (PII_NAME + r"\s*[:：]?\s*(" + PII_WORD + r"(?:\s+(?!" + PII_STOP + r"\b)" + PII_WORD + r"){0,2})(?![\d\-])", "$1 [NAME]"),
)


def mask_pii(c: Column) -> Column:
    """Addresses, phone numbers, labelled document numbers and names; never bare codes."""
    for pattern, to in PII:
        c = F.regexp_replace(c, pattern, to)
    return c


#: Fixed value: what a provider's message may leak.
SECRET = r"""(?i)(sk-[a-z0-9_\-]{6,}|bearer\s+[a-z0-9._\-]{6,}|(?:api[_\-]?key|apikey|token|password|secret)["'\s:=]+[a-z0-9._\-/+=]{8,})"""


def redact_secrets(c: Column) -> Column:
    """Keys, bearer headers and assignments."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), SECRET, "<redacted>")


def strip_label_prefix(c: Column, systems: Sequence[str]) -> Column:
    """Without a leading "System[/service]:", spaces collapsed."""
    names = "|".join(systems)
    c = F.regexp_replace(c, rf"(?i)^\s*(?:{names})\s*(?:[/.|\-–]\s*[^:]{{0,60}})?:\s+", "")
    return F.trim(F.regexp_replace(c, SPACES, " "))


def cap_words(c: Column, n: int = 9) -> Column:
    """The first n words."""
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(c, SPACES, " ")), " "), 1, n), " ")


def cap_chars(c: Column, n: int) -> Column:
    """The first n characters of the trimmed text."""
    return F.substring(F.trim(c), 1, n)


def script_lang(c: Column) -> Column:
    """P20: ar if there is an Arabic character, else en."""
    return F.when(c.rlike(ARABIC), "ar").otherwise("en")


def guarded_label(label: Column, title: Column, generic: str, max_chars: int = 60, max_words: int = 9) -> Column:
    """P20: a proposed label if it is Arabic and short, else the title if that is Arabic, else the generic one."""
    first = F.trim(F.split(F.trim(label), "\n")[0])
    ok = first.rlike(ARABIC) & (F.length(first) <= max_chars) & (F.size(F.split(first, SPACES)) <= max_words)
    return F.when(ok, first).when(title.rlike(ARABIC), title).otherwise(F.lit(generic))


def parse_reply(raw: Column, field: str) -> Column:
    """A field of a reply: fences stripped, parsed whole, else its first object, else read from the cut text; else null."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```(json)?", ""), r"```$", ""))
    inner = F.regexp_extract(text, r"(\{[\s\S]*\})", 1)
    cut = F.nullif(F.regexp_extract(text, rf'"{field}"\s*:\s*"([^"]*)"', 1), F.lit(""))
    return F.coalesce(F.get_json_object(text, f"$.{field}"), F.get_json_object(inner, f"$.{field}"), cut)


CLASSIFICATION = "affected_system string, service string, incident_type string, severity string, urgency string, category string, confidence string, reasoning string, canonical_statement string, ticket_kind string, classification_status string, needs_review boolean"


def parse_classification(json: Column) -> Column:
    """A typed struct; of a bad text all fields are null."""
    return F.from_json(F.coalesce(json, F.lit("{}")), CLASSIFICATION, {"mode": "PERMISSIVE"})


def parse_vector(text: Column) -> Column:
    """P23: '[1,2]' as numbers."""
    return F.from_json(text, "array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0.0 for a zero vector, null for a missing one."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).when(a.isNotNull() & b.isNotNull(), F.lit(0.0))


def cluster_id(system: Column, name: Column, member_ids: Column) -> Column:
    """P25: stable id of a cluster; `member_ids` is an array of strings."""
    key = F.concat_ws("|", F.coalesce(F.nullif(system, F.lit("")), F.lit(UNKNOWN)), name, F.array_join(F.array_sort(member_ids), ","))
    return F.concat(F.lit("cl_"), F.substring(F.sha2(key, 256), 1, 12))


def pair_key(a: Column, b: Column, version: str) -> Column:
    """One key for a pair in either order."""
    return F.concat_ws("|", F.lit(version), F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def failure_code(message: Column, phase: Column) -> Column:
    """A stable code of a failure."""
    low = F.lower(F.coalesce(message, F.lit("")))
    marked = F.lit(False)
    for m in EMBEDDING_MARKERS:
        marked = marked | F.contains(low, F.lit(m))
    return F.when(phase == "persist", "DB_FAILURE").when(marked, "EMBEDDING_FAILED").when(F.contains(low, F.lit("timeout")), "LLM_TIMEOUT").otherwise("LLM_UNAVAILABLE")


def is_failed(status: Column, json_status: Column, reasoning: Column) -> Column:
    """Failed by either status, or by the mark in the reasoning."""
    no = F.lit(False)
    return F.coalesce(status == "failed", no) | F.coalesce(json_status == "failed", no) | F.coalesce(F.startswith(reasoning, F.lit("Classification failed after")), no)


def team_of(group: Column) -> Column:
    """The first team with a keyword in the group's name."""
    g, out = F.lower(group), F.lit(DEFAULT_TEAM)
    for team, words in reversed(TEAMS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(g, F.lit(w))
        out = F.when(F.coalesce(hit, F.lit(False)), team).otherwise(out)
    return out


def ground_value(value: Column, text: Column, quality: Column) -> Column:
    """An extracted value only if its normal form occurs in the text's; nothing of an unreadable image."""
    found = F.contains(normalize_code(text), normalize_code(value))
    return F.when(F.coalesce(quality != "unreadable", F.lit(True)) & (F.coalesce(normalize_code(text), F.lit("")) != "") & found, value)


def severity_rank(severity: Column) -> Column:
    """Rank of a severity, 0 for anything else."""
    out = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def severity_name(rank: Column) -> Column:
    """The severity of a rank; Minor for 0."""
    out = F.lit("Minor")
    for name, r in SEVERITY_RANK.items():
        out = F.when(rank == r, name).otherwise(out)
    return out
