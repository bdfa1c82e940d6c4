"""Chat-request batches: assemble, validate, sanitize, fingerprint, clamp,
render prompts, build request envelopes and parse model responses.

Everything is Column expressions and one keyed aggregation (assembly). The
only per-group collection is a request's own message list: a request is one
row, whole, and ``oversize`` tells whether it is above the body-size cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masking import mask_text, sanitize_prompt

# ---------------------------------------------------------------------------
# Fixed values (must match the reference's behaviour).
BODY_LIMIT_BYTES = 10 * 1024 * 1024          # JSON body cap -> HTTP 413
DEFAULT_TEMPERATURE = 0.1                    # `temperature || 0.1`
MAX_TEMPERATURE = 0.3                        # `Math.min(..., 0.3)`
FINGERPRINT_HEX = 16                         # sha256 hex prefix length
ENVELOPE_MODEL = "local-model"
ENVELOPE_TEMPERATURE = 0.1
ENVELOPE_MAX_TOKENS = 2000
SYSTEM_PROMPT = ("You are a data engineering expert. Analyze the provided information "
                 "and respond with structured JSON.")
PARSE_FAILED = "Failed to parse LLM response"

PROMPT_DATABASE = """
Analyze this database schema and provide insights:

Schema: {payload}

Please provide:
1. Table relationships and foreign key connections
2. Data hierarchy and dependencies
3. Performance optimization recommendations
4. Potential data quality issues

Respond in JSON format with keys: relationships, hierarchy, recommendations.
"""

PROMPT_CODE = """
Analyze this codebase for data engineering patterns:

Code Analysis: {payload}

Please identify:
1. Data flow between components
2. Dependencies and coupling
3. Performance bottlenecks
4. Optimization opportunities

Respond in JSON format with keys: dataFlow, dependencies, optimizations.
"""

PROMPT_KPI = """
Analyze this KPI requirement and determine data needs:

KPI Description: {payload}

Please identify:
1. Required data fields
2. Source tables needed
3. Join conditions required
4. Calculation logic
5. Consistency fields needed

Respond in JSON format with keys: fields, tables, joins, calculations, consistency.
"""

PROMPT_IMPROVEMENTS = """
Based on this analysis, suggest improvements:

Analysis Data: {payload}

Please provide:
1. Performance optimizations
2. Architecture improvements
3. Data quality enhancements
4. Monitoring recommendations

Respond in JSON format with keys: performance, architecture, quality, monitoring.
"""

# Response keys and the fallback value of each (JSON text) when the model's
# text is not JSON.
RESPONSE_KEYS = {
    "database": {"relationships": "[]", "hierarchy": "{}",
                 "recommendations": '["' + PARSE_FAILED + '"]'},
    "code": {"dataFlow": "{}", "dependencies": "[]",
             "optimizations": '["' + PARSE_FAILED + '"]'},
    "kpi": {"fields": "[]", "tables": "[]", "joins": "[]", "calculations": "[]",
            "consistency": "[]"},
    "improvements": {"performance": "[]", "architecture": "[]", "quality": "[]",
                     "monitoring": "[]"},
}

# Result projections applied by the app to parsed responses.
RESULT_NAMES = {
    "kpi": {"fields": "requiredFields", "tables": "sourceTables", "joins": "joinConditions",
            "calculations": "calculations", "consistency": "consistencyFields"},
    "database": {"relationships": "relationships", "hierarchy": "hierarchy",
                 "recommendations": "recommendations"},
    "code": {"dataFlow": "dataFlow", "dependencies": "dependencies",
             "optimizations": "optimizations"},
    "improvements": {"performance": "performance", "architecture": "architecture",
                     "quality": "quality", "monitoring": "monitoring"},
}
# ---------------------------------------------------------------------------

TEMPLATES = {"database": PROMPT_DATABASE, "code": PROMPT_CODE, "kpi": PROMPT_KPI,
             "improvements": PROMPT_IMPROVEMENTS}

_JSON_OPTS = {"ignoreNullFields": "false"}


def message_json_bytes(role: Column, content: Column) -> Column:
    """Bytes of one message rendered as compact JSON."""
    return F.octet_length(F.to_json(F.struct(role.alias("role"), content.alias("content")),
                                    _JSON_OPTS))


def assemble_requests(messages: DataFrame, key: str = "conv_id", order: str = "turn",
                      role: str = "role", content: str = "content",
                      temperature: str | None = "temperature",
                      limit_bytes: int = BODY_LIMIT_BYTES) -> DataFrame:
    """One request per key with its ordered ``messages`` array.

    A request is its whole conversation (the fingerprint is over all of it), so
    its messages meet in one row; nothing is left out however long it is.
    ``body_bytes`` is the size of ``{"messages":[m1,m2,...]}`` and ``oversize``
    tells whether that exceeds ``limit_bytes`` (the proxy's body limit)."""
    sized = messages.select(key, order, role, content, *([temperature] if temperature else []),
                            message_json_bytes(F.col(role), F.col(content)).alias("_b"))
    aggs = [
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"),
                                             F.col(content).alias("content")))).alias("_m"),
        (F.sum("_b") + F.count(F.lit(1)) - 1 + len('{"messages":[]}')).alias("body_bytes"),
        F.count(F.lit(1)).alias("n_messages"),
    ]
    if temperature:
        # one temperature per request; max keeps the choice deterministic on retries
        aggs.append(F.max(temperature).alias("temperature"))
    return sized.groupBy(key).agg(*aggs).select(
        key,
        F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"),
        "n_messages", "body_bytes", (F.col("body_bytes") > F.lit(limit_bytes)).alias("oversize"),
        *(["temperature"] if temperature else []))


def parse_body(body: Column) -> Column:
    """The ``messages`` of a JSON request body; null where the body has none,
    or something other than an array, or is no JSON."""
    return F.from_json(body, "messages ARRAY<STRUCT<role: STRING, content: STRING>>")["messages"]


def is_valid(messages: Column) -> Column:
    """Messages must be present and an array (an empty array is valid)."""
    return messages.isNotNull()


def sanitize_messages(messages: Column) -> Column:
    """Content of every message <- sanitize_prompt; other fields kept."""
    return F.transform(messages, lambda m: m.withField("content", sanitize_prompt(m["content"])))


def has_null_content(messages: Column) -> Column:
    """A message without string content makes sanitizing fail (HTTP 500)."""
    return F.exists(messages, lambda m: m["content"].isNull())


def fingerprint(messages: Column) -> Column:
    """First 16 hex chars of sha256 over the compact JSON of the messages."""
    return F.substring(F.sha2(F.to_json(messages, _JSON_OPTS), 256), 1, FINGERPRINT_HEX)


def clamp_temperature(t: Column) -> Column:
    """``min(t || 0.1, 0.3)``: NULL, 0 and NaN -> 0.1; negatives pass."""
    falsy = t.isNull() | (t == 0) | F.isnan(t)
    base = F.when(falsy, F.lit(DEFAULT_TEMPERATURE)).otherwise(t)
    return F.least(base, F.lit(MAX_TEMPERATURE))


def status(admitted: Column, messages: Column) -> Column:
    """429 (rate limit) > 400 (invalid) > 500 (bad content) > 200."""
    return (F.when(~admitted, F.lit(429))
            .when(~is_valid(messages), F.lit(400))
            .when(has_null_content(messages), F.lit(500))
            .otherwise(F.lit(200)))


def sanitize_response(choices: Column) -> Column:
    """Sanitize ``choices[0].message.content`` only, when present."""
    return F.transform(choices, lambda c, i: F.when(
        (i == 0) & c["message"].isNotNull(),
        c.withField("message", c["message"].withField(
            "content", sanitize_prompt(c["message"]["content"])))).otherwise(c))


def render_prompt(kind: str, payload: Column) -> Column:
    """Template text around a payload (compact JSON or plain text)."""
    before, after = TEMPLATES[kind].split("{payload}")
    return F.concat(F.lit(before), payload, F.lit(after))


def kpi_prompt(description: Column) -> Column:
    """The KPI description is masked (mask_text) before rendering."""
    return render_prompt("kpi", mask_text(description))


def envelope(prompt: Column) -> Column:
    """The chat request body sent to the model, as compact JSON."""
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    return F.to_json(F.struct(F.lit(ENVELOPE_MODEL).alias("model"), msgs.alias("messages"),
                              F.lit(ENVELOPE_TEMPERATURE).alias("temperature"),
                              F.lit(ENVELOPE_MAX_TOKENS).alias("max_tokens")))


def parse_response(kind: str, text: Column) -> Column:
    """Struct of the expected keys, each as JSON text.

    Text that is not JSON gives the default value of every key; valid JSON
    lacking a key gives NULL for it (as the reference does)."""
    bad = F.try_parse_json(text).isNull()
    fields = []
    for k, default in RESPONSE_KEYS[kind].items():
        fields.append(F.when(bad, F.lit(default))
                      .otherwise(F.get_json_object(text, f"$.{k}")).alias(k))
    return F.struct(*fields)
