"""Chat-request batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import sql_literal as lit
from ..operators import chat, limiter
from ..sources import fixtures as FX
from ..sources.tables import table
from . import oracle as O
from .registry import register

# ---------------------------------------------------------------------------
# DuckDB pieces

_ASSEMBLE = f"""{FX.cte('f_chat')},
req AS (
  SELECT conv_id,
         list(struct_pack(role := role, content := content) ORDER BY turn) AS msgs,
         count(*) AS n_messages,
         sum(strlen(to_json(struct_pack(role := role, content := content)))) + count(*) - 1
           + {len('{"messages":[]}')} AS body_bytes,
         max(temperature) AS temperature
  FROM f_chat GROUP BY conv_id
), san AS (
  SELECT *, list_transform(msgs, lambda m: struct_pack(role := m.role,
                 content := {O.sanitize_sql('m.content')})) AS smsgs
  FROM req
)"""

_CLAMP = ("least(CASE WHEN temperature IS NULL OR temperature = 0 OR isnan(temperature) "
          "THEN 0.1 ELSE temperature END, 0.3)")
_STATUS_NO_LIMIT = ("CASE WHEN msgs IS NULL THEN 400 "
                    "WHEN list_bool_or(list_transform(msgs, lambda m: m.content IS NULL)) THEN 500 "
                    "ELSE 200 END")


def _requests(spark, sf_dir):
    msgs = FX.fixture(spark, sf_dir, "f_chat")
    return chat.assemble_requests(msgs)


# --- X1–X5: assemble, validate, sanitize, fingerprint, clamp --------------------

@register("chat_requests_fchat", f"""WITH {_ASSEMBLE}
SELECT conv_id, n_messages, CAST(body_bytes AS BIGINT) AS body_bytes,
       {_CLAMP} AS temperature,
       substr(sha256(to_json(smsgs)), 1, 16) AS fingerprint,
       CAST({_STATUS_NO_LIMIT} AS INTEGER) AS status,
       smsgs[1].content AS first_content
FROM san""", "X1 X2 X3 X4 X5")
def chat_requests_fchat(spark, sf_dir):
    r = _requests(spark, sf_dir)
    s = chat.sanitize_messages(F.col("messages"))
    return r.select(
        "conv_id", "n_messages", "body_bytes",
        chat.clamp_temperature(F.col("temperature")).alias("temperature"),
        chat.fingerprint(s).alias("fingerprint"),
        chat.status(F.lit(True), F.col("messages")).alias("status"),
        s[0]["content"].alias("first_content"))


@register("chat_fingerprint_raw",
          """SELECT conv_id, substr(sha256(to_json(list(struct_pack(role := role, content := text)
                 ORDER BY turn))), 1, 16) AS fingerprint FROM conversations GROUP BY conv_id""",
          "X1 X4")
def chat_fingerprint_raw(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    r = chat.assemble_requests(conv, content="text", temperature=None)
    return r.select("conv_id", chat.fingerprint(F.col("messages")).alias("fingerprint"))


# --- X6 + X8: admission status of each request ---------------------------------
# Requests arrive one per second in conv_id order from three clients.

_ADMIT_ORACLE = f"""WITH RECURSIVE {_ASSEMBLE},
e AS (
  SELECT conv_id % 3 AS client, conv_id AS id, conv_id * 1000000 AS t,
         row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id) AS rn
  FROM (SELECT DISTINCT conv_id FROM conversations)
), r AS (
  SELECT client, id, rn, t AS ws, CAST(1 AS BIGINT) AS n FROM e WHERE rn = 1
  UNION ALL
  SELECT e.client, e.id, e.rn, CASE WHEN e.t >= r.ws + 60000000 THEN e.t ELSE r.ws END,
         CASE WHEN e.t >= r.ws + 60000000 THEN 1 ELSE r.n + 1 END
  FROM r JOIN e ON e.client = r.client AND e.rn = r.rn + 1
)
SELECT s.conv_id, CAST(CASE WHEN r.n > 10 THEN 429 ELSE {_STATUS_NO_LIMIT} END AS INTEGER) AS status,
       CASE WHEN r.n <= 10 AND s.msgs IS NOT NULL THEN substr(sha256(to_json(s.smsgs)), 1, 16) END
         AS fingerprint,
       r.n AS window_position
FROM san s LEFT JOIN r ON r.id = s.conv_id
"""


@register("chat_admission_fchat", _ADMIT_ORACLE, "X6 X8")
def chat_admission_fchat(spark, sf_dir):
    r = _requests(spark, sf_dir)
    # the limiter sees arrivals only, not the messages
    arrivals = table(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") % 3).alias("client"), F.timestamp_seconds("conv_id").alias("ts"))
    adm = limiter.admission(arrivals, key="client", ts="ts", id_col="conv_id",
                            points=limiter.POINTS, duration_seconds=limiter.DURATION_SECONDS)
    j = r.join(adm.select("conv_id", "n", "admitted"), "conv_id", "left")
    st = chat.status(F.coalesce("admitted", F.lit(True)), F.col("messages"))
    fp = F.when(F.col("admitted") & F.col("messages").isNotNull(),
                chat.fingerprint(chat.sanitize_messages(F.col("messages"))))
    return j.select("conv_id", st.alias("status"), fp.alias("fingerprint"),
                    F.col("n").alias("window_position"))


# --- X2 + X8: request bodies of every status --------------------------------------
# Each client sends 25 requests, one a second. Some bodies have no messages, or
# no list of them, or an empty one; some messages have no content.

_BAD_BODIES = {4: '{"prompt":"hi"}', 5: '{"messages":"none"}', 6: '{"messages":[]}', 8: '{"messages":'}

_BODIES_ORACLE = f"""WITH {FX.cte('f_chat')},
m AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN NULL ELSE content END AS content FROM f_chat),
r AS (SELECT conv_id, list(struct_pack(role := role, content := {O.sanitize_sql('content')}) ORDER BY turn) AS msgs, bool_or(content IS NULL) AS bad FROM m GROUP BY conv_id),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id // 25 ORDER BY conv_id) AS n FROM r),
s AS (SELECT *, CASE WHEN n > {limiter.POINTS} THEN 429 WHEN conv_id % 9 IN (4, 5, 8) THEN 400 WHEN conv_id % 9 = 6 THEN 200 WHEN bad THEN 500 ELSE 200 END AS status FROM n)
SELECT conv_id, CAST(status AS INTEGER) AS status, n AS window_position, CASE WHEN status = 200 THEN CASE WHEN conv_id % 9 = 6 THEN 0 ELSE len(msgs) END END AS n_messages,
       CASE WHEN status = 200 THEN substr(sha256(CASE WHEN conv_id % 9 = 6 THEN '[]' ELSE CAST(to_json(msgs) AS VARCHAR) END), 1, 16) END AS fingerprint FROM s"""


@register("chat_statuses_fchat", _BODIES_ORACLE, "X2 X3 X6 X8")
def chat_statuses_fchat(spark, sf_dir):
    msgs = FX.fixture(spark, sf_dir, "f_chat")
    msgs = msgs.withColumn("content", F.when((F.col("conv_id") % 7 != 3) | (F.col("turn") != 1), F.col("content")))
    r = chat.assemble_requests(msgs)
    body = F.to_json(F.struct("messages"), {"ignoreNullFields": "false"})
    for k, bad in _BAD_BODIES.items():
        body = F.when(F.col("conv_id") % 9 == k, F.lit(bad)).otherwise(body)
    r = r.select("conv_id", body.alias("body")).select("conv_id", chat.parse_body(F.col("body")).alias("messages"))
    arrivals = table(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        "conv_id", F.floor(F.col("conv_id") / 25).alias("client"), F.timestamp_seconds("conv_id").alias("ts"))
    adm = limiter.admission(arrivals, key="client", ts="ts", id_col="conv_id",
                            points=limiter.POINTS, duration_seconds=limiter.DURATION_SECONDS)
    st = chat.status(F.col("admitted"), F.col("messages"))
    j = r.join(adm.select("conv_id", "n", "admitted"), "conv_id").withColumn("status", st)
    fine = F.col("status") == 200
    return j.select("conv_id", "status", F.col("n").alias("window_position"), F.when(fine, F.size("messages")).cast("long").alias("n_messages"),
                    F.when(fine, chat.fingerprint(chat.sanitize_messages(F.col("messages")))).alias("fingerprint"))


# --- X9: response sanitizing ------------------------------------------------------

@register("chat_response_fchat", f"""WITH {FX.cte('f_chat')}
SELECT conv_id, turn, {O.sanitize_sql('content')} AS choice0_content, content AS choice1_content
FROM f_chat""", "X9")
def chat_response_fchat(spark, sf_dir):
    src = FX.fixture(spark, sf_dir, "f_chat")
    choice = lambda i: F.struct(F.lit(i).alias("index"),
                                F.struct(F.lit("assistant").alias("role"),
                                         F.col("content").alias("content")).alias("message"))
    resp = src.select("conv_id", "turn", F.array(choice(0), choice(1)).alias("choices"))
    out = resp.select("conv_id", "turn", chat.sanitize_response(F.col("choices")).alias("c"))
    return out.select("conv_id", "turn", F.col("c")[0]["message"]["content"].alias("choice0_content"),
                      F.col("c")[1]["message"]["content"].alias("choice1_content"))


# --- X12 + X14: KPI prompt (masked) inside a request envelope --------------------

def _template_sql(kind: str, payload_sql: str) -> str:
    before, after = chat.TEMPLATES[kind].split("{payload}")
    return f"concat({lit(before)}, {payload_sql}, {lit(after)})"


def _envelope_sql(prompt_sql: str) -> str:
    return (f"to_json(struct_pack(model := {lit(chat.ENVELOPE_MODEL)}, messages := ["
            f"struct_pack(role := 'system', content := {lit(chat.SYSTEM_PROMPT)}), "
            f"struct_pack(role := 'user', content := {prompt_sql})], "
            f"temperature := 0.1, max_tokens := 2000))")


@register("chat_kpi_envelope_ftext", f"""WITH {FX.cte('f_text')}
SELECT doc_id, {_envelope_sql(_template_sql('kpi', O.mask_text_sql('text')))} AS request
FROM f_text""", "X12 X14")
def chat_kpi_envelope_ftext(spark, sf_dir):
    src = FX.fixture(spark, sf_dir, "f_text")
    return src.select("doc_id", chat.envelope(chat.kpi_prompt(F.col("text"))).alias("request"))


# --- X13: improvements prompt over an analysis table (not masked) ----------------

@register("chat_improvements_prompt", f"""
SELECT source, lang, {_template_sql('improvements',
    "to_json(struct_pack(source := source, lang := lang, n_docs := count(*), chars := sum(n_chars)))")}
    AS prompt
FROM documents GROUP BY source, lang""", "X13")
def chat_improvements_prompt(spark, sf_dir):
    g = (table(spark, sf_dir, "documents").groupBy("source", "lang")
         .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("chars")))
    payload = F.to_json(F.struct("source", "lang", "n_docs", "chars"))
    return g.select("source", "lang", chat.render_prompt("improvements", payload).alias("prompt"))


# --- X15–X19: parse model responses, fall back on non-JSON, project ---------------

_RESP_TEXT = ("""CASE WHEN conv_id % 2 = 0 THEN concat('{"relationships": [', CAST(turn AS VARCHAR), """
              """'], "hierarchy": {"t": ', CAST(conv_id AS VARCHAR), """
              """'}, "dataFlow": {"a": [1]}, "fields": ["f', CAST(turn AS VARCHAR), '"], """
              """"performance": [1, 2], "monitoring": []}') ELSE text END""")
_KINDS = ["database", "code", "kpi", "improvements"]


def _parse_sql() -> str:
    parts = []
    for i, kind in enumerate(_KINDS):
        names = chat.RESULT_NAMES[kind]
        keys = list(chat.RESPONSE_KEYS[kind].items())
        fields = ", ".join(lit(names[k]) for k, _ in keys)
        vals = ", ".join(
            f"CASE WHEN json_valid(text) THEN json_extract(text, '$.{k}')::VARCHAR ELSE {lit(d)} END"
            for k, d in keys)
        parts.append(f"SELECT request_id, {lit(kind)} AS kind, unnest([{fields}]) AS field, "
                     f"unnest([{vals}]) AS value FROM resp WHERE turn % 4 = {i}")
    return (f"WITH resp AS (SELECT conv_id * 1000 + turn AS request_id, turn, {_RESP_TEXT} AS text "
            f"FROM conversations) " + " UNION ALL ".join(parts))


@register("chat_parse_responses", _parse_sql(), "X15 X16 X17 X18 X19")
def chat_parse_responses(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    resp = conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "turn",
                       F.expr(_RESP_TEXT.replace("CAST(turn AS VARCHAR)", "CAST(turn AS STRING)")
                              .replace("CAST(conv_id AS VARCHAR)", "CAST(conv_id AS STRING)"))
                       .alias("text"))
    kind_col = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("turn") % 4 + 1).cast("int"))
    per_kind = None
    for i, kind in enumerate(_KINDS):
        parsed = chat.parse_response(kind, F.col("text"))
        # Expose each parsed key under the app's result name
        arr = F.array(*[F.struct(F.lit(name).alias("field"), parsed[k].alias("value"))
                        for k, name in chat.RESULT_NAMES[kind].items()])
        per_kind = F.when(F.col("turn") % 4 == i, arr) if per_kind is None else \
            per_kind.when(F.col("turn") % 4 == i, arr)
    return (resp.select("request_id", kind_col.alias("kind"), F.inline(per_kind))
            .select("request_id", "kind", "field", F.col("value").cast("string").alias("value")))
