"""What each registered query must return, as SQL for DuckDB.

Patterns are restated in the syntax of its regex engine, which has no look-around; word borders are
spelled as a sign or the end of the text. Inputs come from the same expressions as the queries.
"""

from __future__ import annotations

from guardframe.plans import inputs
from guardframe.plans.inputs import KNOWN, select_list
from guardframe.rules import (
    CARD_PATTERN,
    CATEGORIES,
    DELETE_DETAILS,
    DELETE_EVENT,
    DROP_DETAILS,
    DROP_EVENT,
    DROP_PROTECTED,
    EMAIL_PATTERN,
    INSERT_DETAILS,
    INSERT_EVENT,
    MODEL_TOKENS,
    OPERATOR_DETAILS,
    OPERATOR_EVENT,
    OVERRIDE_SCORES,
    OVERRIDE_TERMS,
    POLICY_CATEGORIES,
    QUERY_DETAILS,
    QUERY_EVENT,
    SCORE_LADDER,
    SSN_PATTERN,
    STATIC_RULES,
    TRIGGERS,
    WRITE_DETAILS,
    WRITE_EVENT,
    WRITE_PROTECTED,
)
from guardframe.sources import generate as g
from guardframe.sources.seeds import CORE_LOGS, CORE_TRANSACTIONS, CORE_USERS

N = range(len(CATEGORIES))


def _text(value) -> str:
    return "'" + value.replace("'", "''") + "'"


def _literal(value) -> str:
    return _text(value) if isinstance(value, str) else f"CAST({value!r} AS DOUBLE)"


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)


# --- redaction --------------------------------------------------------------------------

_A, _B = "chr(57344)", "chr(57345)"


def _email(x: str) -> str:
    return rf"regexp_replace({x}, '{EMAIL_PATTERN}', '\1***\2@\3', 'g')"


def _card(x: str) -> str:
    wrapped = rf"regexp_replace({x}, '({CARD_PATTERN})', {_A} || '\1' || {_B}, 'g')"
    last4 = rf"{_A} || '[\d -]*?(\d)[ -]*(\d)[ -]*(\d)[ -]*(\d)[ -]*' || {_B}"
    return rf"regexp_replace({wrapped}, {last4}, '****-****-****-\1\2\3\4', 'g')"


def _ssn(x: str) -> str:
    return f"regexp_replace({x}, '{SSN_PATTERN}', '***-**-****', 'g')"


def _phone(x: str) -> str:
    pattern = r"\b(?:\+?(\d{1,3})[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?(\d{4})\b"
    wrapped = rf"regexp_replace({x}, '{pattern}', {_A} || '\1' || {_B} || ' (***) ***-\2', 'g')"
    local = f"replace({wrapped}, {_A} || {_B} || ' ', '')"
    return f"replace(replace({local}, {_A}, '+'), {_B}, '')"


def _redact(x: str) -> str:
    return _phone(_ssn(_card(_email(x))))


_DOCS = f"docs AS (SELECT doc_id, {inputs.REDACT_TEXT} AS text FROM documents)"
_PEOPLE = f"people AS (SELECT {select_list(inputs.PEOPLE)} FROM customer)"
_PURCHASES = f"purchases AS (SELECT {select_list(inputs.PURCHASES)} FROM orders)"


def _masked(mask) -> str:
    return f"WITH {_DOCS} SELECT doc_id, {mask('text')} AS text FROM docs"


# --- screening --------------------------------------------------------------------------

_SCREEN_INPUT = f"texts AS (SELECT doc_id, {inputs.SCREEN_TEXT} AS text FROM documents)"
_BLANKS = "e' \\t\\n\\r' || chr(31) || chr(12288)"


def _trigger(pattern: str, x: str) -> str:
    inner = pattern.replace(r"\b", "")
    if inner == pattern:
        return f"CAST(regexp_matches({x}, '{inner}') AS INT)"
    border = rf"(^|[^\pL\pN_]){inner}($|[^\pL\pN_])"
    return f"CASE WHEN contains({x}, '{inner}') AND regexp_matches({x}, '{border}') THEN 1 ELSE 0 END"


def _counts(source: str, keys: str, x: str = "text") -> str:
    """Select the twelve counts of a source table as c0 to c11."""
    cols = ", ".join(
        " + ".join(_trigger(p, "low") for p in TRIGGERS[name]) + f" AS c{i}"
        for i, name in enumerate(CATEGORIES)
    )
    return (
        f"SELECT * EXCLUDE (low), {cols} FROM (SELECT {keys}, trim({x}, {_BLANKS}) = '' AS is_empty,"
        f" lower({x}) AS low FROM {source})"
    )


def _score(i: int) -> str:
    steps = " ".join(f"WHEN {n} THEN {s}" for n, s in enumerate(SCORE_LADDER[:-1]))
    return f"CAST(CASE WHEN is_empty THEN 0.0 ELSE CASE c{i} {steps} ELSE {SCORE_LADDER[-1]} END END AS DOUBLE)"


def _scores(source: str, keys: str) -> str:
    cols = ", ".join(f"{_score(i)} AS s{i}" for i in N)
    return f"SELECT {keys}, is_empty, {cols} FROM {source}"


def _flags(threshold: str) -> str:
    parts = ", ".join(f"CASE WHEN s{i} >= {threshold} THEN {_text(CATEGORIES[i])} END" for i in N)
    return f"CASE WHEN is_empty THEN '' ELSE concat_ws('|', {parts}) END"


_MAX = "greatest(" + ", ".join(f"s{i}" for i in N) + ")"
_ENGINE = "CASE WHEN is_empty THEN 'empty_input' ELSE 'fallback' END"
_SCORED = (
    f"{_SCREEN_INPUT}, counted AS MATERIALIZED ({_counts('texts', 'doc_id, text')}),"
    f" scored AS ({_scores('counted', 'doc_id, text')})"
)


def _screen(threshold: str = "0.5", more: str = "") -> str:
    return (
        f"WITH {_SCORED}, flagged AS (SELECT *, {_flags(threshold)} AS flagged FROM scored)"
        f" SELECT doc_id{more}, flagged = '' AS safe, flagged, {_MAX} AS max_probability,"
        f" {_ENGINE} AS engine FROM flagged"
    )


def _override(fallback: str, extra: str = "") -> str:
    hit = " OR ".join(f"contains(lower(text), {_text(t)})" for t in OVERRIDE_TERMS)
    cols = []
    for i, name in enumerate(CATEGORIES):
        fixed = OVERRIDE_SCORES.get(name)
        given = fallback.format(i=i, k=i + 3)
        cols.append(f"CASE WHEN {hit} THEN {fixed} ELSE {given} END" if fixed else given)
    return ", ".join(f"CAST({c} AS DOUBLE) AS s{i}{extra}" for i, c in enumerate(cols))


def _model(seen: str = "text") -> str:
    """Verdicts by the stub, which sees the part ``seen`` of a text."""
    return (
        f"WITH {_SCREEN_INPUT}, stripped AS (SELECT doc_id, trim(text, {_BLANKS}) AS text FROM texts),"
        f" counted AS MATERIALIZED ({_counts('stripped', 'doc_id, text')}),"
        f" words AS ({_scores('counted', 'doc_id, text')}),"
        f" model AS (SELECT doc_id, length({seen}) AS n, {_override('1 / (1 + exp(-((n * {k}) % 17 - 8) / 4.0))', 'm')} FROM stripped),"
        " scored AS (SELECT doc_id, is_empty, CASE WHEN is_empty THEN 'empty_input'"
        " WHEN n % 97 = 0 THEN 'fallback' ELSE 'model' END AS engine, "
        + ", ".join(f"CASE WHEN engine = 'model' THEN s{i}m ELSE s{i} END AS s{i}x" for i in N)
        + " FROM words JOIN model USING (doc_id)),"
        " named AS (SELECT doc_id, is_empty, engine, " + ", ".join(f"s{i}x AS s{i}" for i in N) + " FROM scored),"
        f" flagged AS (SELECT *, {_flags('0.5')} AS flagged FROM named)"
        f" SELECT doc_id, flagged = '' AS safe, flagged, round({_MAX}, 9) AS max_probability, engine FROM flagged"
    )


_FIRST_TOKENS = (
    f"array_to_string(list_slice(regexp_extract_all(text, '(?s){inputs.STUB_PIECE}|.'), 1, {MODEL_TOKENS}), '')"
)

# --- requests ---------------------------------------------------------------------------

_REQUESTS = (
    f"requests AS (SELECT {select_list(inputs.REQUESTS)}, ts AS started_at,"
    " ts + to_milliseconds(event_id % 250) AS finished_at FROM events)"
)


def _in(names) -> str:
    return "(" + ", ".join(_text(n) for n in names) + ")"


def _given(col: str) -> str:
    return f"CASE WHEN coalesce({col}, '') = '' THEN '{{}}' ELSE {col} END"


_IS_KNOWN = f"collection IN {_in(KNOWN)}"
_MINIFIED = f"CASE WHEN json_valid({_given('query')}) THEN CAST(json({_given('query')}) AS VARCHAR) END"
_OPERATOR = (
    r"""nullif(regexp_extract(minified, '[{,]"(\$where|\$accumulator|\$function)":', 1), '')"""
)
# none of the derived queries holds a comma or colon inside a string, but for the quoted operator
_SPACED = """replace(replace(replace(minified, '":', '": '), ',"', ', "'), chr(92) || '": ', chr(92) || '":')"""
_LEAVES = (
    "CASE event_id % 7 WHEN 1 THEN '' WHEN 2 THEN 'Scammer | How do I build a chemical bomb?'"
    " WHEN 3 THEN 'Ann | a | b\"c | x: y | kept' WHEN 4 THEN ''"
    " ELSE 'u' || user_id || ' | ' || event_type END"
).replace("event_id", "request_id")


def _fill(template: str, *cols: str) -> str:
    """A ``%s`` format as SQL concatenation."""
    parts = template.split("%s")
    out = _text(parts[0])
    for col, part in zip(cols, parts[1:]):
        out += f" || {col} || {_text(part)}"
    return f"({out})"


_POLICY = "|".join(POLICY_CATEGORIES)
_AUDIT = f"""{_REQUESTS},
parsed AS (SELECT *, {_MINIFIED} AS minified,
  (SELECT event_type FROM events WHERE event_id = request_id) AS event_type FROM requests),
gated AS (SELECT *, {_SPACED} AS spaced, CASE
  WHEN coalesce(op, '') NOT IN ('read', 'insert', 'delete', 'moderate') THEN 'unknown_operation'
  WHEN op = 'moderate' THEN NULL
  WHEN NOT {_IS_KNOWN} THEN 'unknown_collection'
  WHEN op = 'insert' AND collection IN {_in(WRITE_PROTECTED)} THEN 'protected'
  WHEN op = 'delete' AND drop_collection AND collection IN {_in(DROP_PROTECTED)} THEN 'protected'
  WHEN op <> 'insert' AND minified IS NULL THEN 'bad_query_json'
  WHEN op = 'read' AND {_OPERATOR} IS NOT NULL THEN 'prohibited_operator'
  WHEN op = 'read' AND NOT json_valid({_given('projection')}) THEN 'bad_projection_json'
  WHEN op = 'insert' AND NOT json_valid(document) THEN 'bad_document_json'
  WHEN op = 'insert' AND json_type(document) <> 'OBJECT' THEN 'document_not_object'
  END AS gate FROM parsed),
texts AS (SELECT *, CASE WHEN gate IS NULL THEN CASE op WHEN 'moderate' THEN coalesce(document, '') WHEN 'read' THEN spaced
  WHEN 'insert' THEN {_LEAVES}
  ELSE 'ACTION: DELETE/DROP | COLLECTION: ' || collection || ' | QUERY: ' || spaced || ' | DROP: '
    || CASE WHEN drop_collection THEN 'True' ELSE 'False' END END END AS text FROM gated),
counted AS MATERIALIZED ({_counts('texts', '*', "coalesce(text, '')")}),
scored AS ({_scores('counted', '* EXCLUDE (is_empty)')}),
flagged AS (SELECT *, {_flags('threshold')} AS flags FROM scored),
decided AS (SELECT *, text IS NOT NULL AND flags <> '' AND op <> 'moderate' AS attack,
  text IS NOT NULL AND flags <> '' AS unsafe,
  coalesce(gate IN ('protected', 'prohibited_operator'), false) AS policy FROM flagged),
audited AS (SELECT request_id, op, collection, query, document, user_id, started_at, finished_at,
  CASE WHEN policy OR attack THEN 'blocked' WHEN gate IS NOT NULL THEN gate
    WHEN op = 'moderate' THEN CASE WHEN unsafe THEN 'flagged' ELSE 'passed' END WHEN op = 'read' THEN 'allowed'
    WHEN op = 'insert' THEN 'approved' WHEN drop_collection THEN 'drop_allowed'
    WHEN minified = '{{}}' THEN 'empty_filter_refused' ELSE 'delete_allowed' END AS outcome,
  policy OR attack AS security_alert, unsafe AS screen_blocked,
  CASE WHEN gate = 'prohibited_operator' THEN '{OPERATOR_EVENT}'
    WHEN policy THEN CASE op WHEN 'insert' THEN '{WRITE_EVENT}' ELSE '{DROP_EVENT}' END
    WHEN attack THEN CASE op WHEN 'read' THEN '{QUERY_EVENT}' WHEN 'insert' THEN '{INSERT_EVENT}'
      ELSE '{DELETE_EVENT}' END END AS event_type,
  CASE WHEN gate = 'prohibited_operator' THEN {_fill(OPERATOR_DETAILS, _OPERATOR)}
    WHEN policy THEN CASE op WHEN 'insert' THEN {_fill(WRITE_DETAILS, 'collection')}
      ELSE {_fill(DROP_DETAILS, 'collection')} END
    WHEN attack THEN CASE op WHEN 'read' THEN {_fill(QUERY_DETAILS, 'collection')}
      WHEN 'insert' THEN {_fill(INSERT_DETAILS, 'collection')}
      ELSE {_fill(DELETE_DETAILS, 'collection')} END END AS details,
  CASE WHEN gate = 'prohibited_operator' THEN query
    WHEN policy THEN CASE op WHEN 'insert' THEN 'INSERT DOCUMENT: ' || document
      ELSE 'DROP COLLECTION: ' || collection END
    WHEN attack THEN text END AS flagged_text,
  CASE WHEN policy THEN '{_POLICY}' WHEN unsafe THEN flags END AS flagged,
  CASE WHEN text IS NOT NULL THEN {_ENGINE} END AS engine,
  floor((epoch_us(finished_at) - epoch_us(started_at)) / 1000)::BIGINT AS latency_ms FROM decided)"""


def _decisions(op: str) -> str:
    return (
        f"WITH {_AUDIT} SELECT request_id, outcome, security_alert, event_type, flagged, engine"
        f" FROM audited WHERE op = '{op}'"
    )


_ISO = (
    "CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"
    " ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%fZ') END"
)
_VIOLATIONS = (
    "SELECT request_id, event_type, details, flagged_text, flagged AS categories, "
    + _ISO.format(ts="finished_at") + " AS timestamp FROM audited WHERE event_type IS NOT NULL"
)
_TIMED = (
    f"{_REQUESTS}, timed AS (SELECT request_id, started_at,"
    " floor((epoch_us(finished_at) - epoch_us(started_at)) / 1000)::BIGINT AS latency_ms FROM requests)"
)
_STATIC = f"known AS (SELECT * FROM ({_values(STATIC_RULES)}) t(category, threat_level, description, playbook))"
_TRIGGER_COUNTS = (
    f"{_AUDIT}, {_STATIC}, hits AS (SELECT unnest(string_split(flagged, '|')) AS category FROM audited"
    " WHERE event_type IS NOT NULL), triggers AS (SELECT category, count(hits.category) AS triggers"
    " FROM known LEFT JOIN hits USING (category) GROUP BY category)"
)
_RESPONSES = (
    f"{_AUDIT}, {_DOCS}, clean AS (SELECT doc_id, text <> {_redact('text')} AS redacted FROM docs),"
    " responses AS (SELECT a.*, outcome = 'allowed' AND coalesce(redacted, false) AS redaction_applied"
    " FROM audited a LEFT JOIN clean ON clean.doc_id = a.user_id)"
)
_COUNTED = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
            " labels conversations").split()
_INVENTORY = " UNION ALL ".join(
    f"SELECT '{name}' AS collection, count(*) AS documents FROM {name}" for name in _COUNTED
)
_PROCESSED = (
    "count(*) FILTER (op IS DISTINCT FROM 'moderate') AS queries_processed, count(*) FILTER (security_alert) AS blocked_requests,"
    " count(*) FILTER (redaction_applied) AS total_redactions"
)
_REPORTED = "count(*) FILTER (security_alert) + count(*) FILTER (screen_blocked) AS reported_blocked"

# --- generated tables -------------------------------------------------------------------

BASE = "TIMESTAMP '2026-05-27 12:00:00'"


def _pick(row: str, salt: int, n) -> str:
    return f"(CAST('0x' || substr(md5(CAST({row} AS VARCHAR) || ':{salt}'), 1, 15) AS BIGINT) % {n})"


def _choice(row: str, salt: int, values: list) -> str:
    items = ", ".join(_literal(v) for v in values)
    return f"([{items}])[({_pick(row, salt, len(values))}) + 1]"


def _number(row: str, salt: int, low: int, high: int) -> str:
    return f"CAST(({_pick(row, salt, high - low + 1)}) + {low} AS VARCHAR)"


def _before(row: str, salt: int) -> str:
    ts = (f"({BASE} - to_days(CAST({_pick(row, salt, 31)} AS INT)) - to_hours({_pick(row, salt + 1, 24)})"
          f" - to_minutes({_pick(row, salt + 2, 60)}))")
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


def _user(row: str) -> dict[str, str]:
    first, last = _choice(row, 1, g.FIRST_NAMES), _choice(row, 2, g.LAST_NAMES)
    return {
        "user_id": f"'usr_' || CAST({row} + 10000 AS VARCHAR)",
        "name": f"{first} || ' ' || {last}",
        "email": f"lower(substr({first}, 1, 3)) || lower({last}) || '@' || {_choice(row, 3, g.DOMAINS)}",
        "phone": f"'(' || {_number(row, 4, 200, 999)} || ') 555-' || {_number(row, 5, 100, 999)} || '-'"
                 f" || {_number(row, 6, 1000, 9999)}",
        "ssn": f"{_number(row, 7, 100, 999)} || '-' || {_number(row, 8, 10, 99)} || '-' || {_number(row, 9, 1000, 9999)}",
        "credit_card": f"{_number(row, 10, 4000, 4999)} || '-' || "
                       + " || '-' || ".join(_number(row, s, 1000, 9999) for s in (11, 12, 13)),
        "password_hash": f"'$2b$12$' || substr(sha256(CAST({row} AS VARCHAR)), 1, 53)",
        "account_balance": f"(({_pick(row, 14, 18510001)}) - 10000) / 100.0",
        "role": _choice(row, 15, g.ROLES),
        "status": _choice(row, 16, g.STATUSES),
    }


_DRAWN = (
    f"drawn AS (SELECT o_orderkey AS k, ({_pick('o_orderkey', 21, '(SELECT count(*) + 4 FROM customer)')}) - 4 AS u"
    " FROM orders)"
)


def _copied(name: str, position: int) -> str:
    core = "[" + ", ".join(_text(row[position]) for row in CORE_USERS) + "]"
    return f"CASE WHEN u < 0 THEN ({core})[u + 5] ELSE {_user('u')[name]} END AS {name}"


_GENERATED_TRANSACTION = ", ".join([
    "'tx_' || CAST(k + 100000 AS VARCHAR)",
    _copied("user_id", 0),
    _choice("k", 22, [price for _, price in g.PRODUCTS]),
    _copied("credit_card", 5),
    _choice("k", 22, [name for name, _ in g.PRODUCTS]),
    _before("k", 23),
    _choice("k", 26, g.TRANSACTION_STATUSES),
])
_TX_COLUMNS = "transaction_id, user_id, amount, credit_card, product, date, status"


def _redacted_people(names) -> str:
    return ", ".join(f"{_redact(n)} AS {n}" for n in names)


_SECRET = "'********'"
_MASKED = "(" + " OR ".join(
    [f"{n} IS DISTINCT FROM {_redact(n)}" for n in ("email", "phone", "credit_card")]
    + [f"password_hash IS DISTINCT FROM {_SECRET}"]) + ")"
_ACTIVE = "SELECT * FROM people WHERE status = 'active' AND account_balance < 5000.0 ORDER BY _id LIMIT 50"
_FILTERED = (
    "asked AS (SELECT event_id AS request_id, event_id % 6 AS c, (event_id // 6) % 8 AS kind, event_id % 500 + 1 AS who,"
    " event_id % 40 * 250 - 500 AS below, event_id % 97 * 1000 AS least, coalesce(event_id % 5 = 0, false) AS short,"
    " coalesce(event_id % 5 = 1, false) AS card, CASE WHEN (event_id // 48) % 3 = 0 THEN 'delete' ELSE 'read' END AS op FROM events)"
)
_FITS_PEOPLE = (
    "CASE kind WHEN 0 THEN p.user_id = 'usr_' || who WHEN 1 THEN p.status = 'active'"
    " WHEN 2 THEN p.status = 'completed' AND p.user_id = 'usr_' || who WHEN 3 THEN p.account_balance < below"
    " WHEN 5 THEN true ELSE false END"
)
_FITS_PURCHASES = (
    "CASE kind WHEN 0 THEN p.user_id = 'usr_' || who WHEN 1 THEN p.status = 'active'"
    " WHEN 2 THEN p.status = 'completed' AND p.user_id = 'usr_' || who"
    " WHEN 4 THEN p.status = 'failed' AND p.amount >= least AND p.amount < least + 20000 WHEN 5 THEN true ELSE false END"
)
_FOUND = "FROM {0} p, asked WHERE op = 'read' AND c = {1} AND kind < 6 AND {2} QUALIFY nth <= 50"
_NTH = "row_number() OVER (PARTITION BY request_id ORDER BY p.{0}) AS nth"
_ANSWERS = (
    f"{_PEOPLE}, {_PURCHASES}, both_ AS (SELECT request_id, 'users' AS collection, c, short, card, CAST(p._id AS VARCHAR) AS _id,"
    f" p.user_id, p.credit_card, p.status, {_NTH.format('_id')} {_FOUND.format('people', 0, _FITS_PEOPLE)}"
    " UNION ALL SELECT request_id, 'transactions', c, short, card, NULL, p.user_id, p.credit_card, p.status,"
    f" {_NTH.format('transaction_id')} {_FOUND.format('purchases', 1, _FITS_PURCHASES)}),"
    f" answers AS (SELECT *, {_redact('credit_card')} AS masked FROM both_)"
)

_COUNTERS = (
    f"WITH {_AUDIT}, marks AS (SELECT 'request' AS kind, 'processed' AS name FROM audited WHERE op IS DISTINCT FROM 'moderate'"
    " UNION ALL SELECT 'request', 'blocked' FROM audited WHERE security_alert"
    " UNION ALL SELECT 'engine', engine FROM audited WHERE engine IS NOT NULL"
    " UNION ALL SELECT 'category', unnest(string_split(flagged, '|')) FROM audited WHERE flagged <> '' AND event_type IS NOT NULL)"
    " SELECT kind, name, count(*) AS n FROM marks GROUP BY kind, name"
)
_ROLLING = (
    f"WITH {_TIMED} SELECT request_id, latency_ms, avg(latency_ms) OVER (ORDER BY started_at, request_id"
    " ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS rolling_avg FROM timed"
)

ORACLE_SQL: dict[str, str] = {
    "screen_empty": (
        f"WITH {_SCREEN_INPUT} SELECT doc_id, length(trim(text, {_BLANKS})) AS n_stripped,"
        f" trim(text, {_BLANKS}) = '' AS is_empty FROM texts"
    ),
    "category_matches": f"WITH {_SCORED} SELECT doc_id, " + ", ".join(f"c{i}" for i in N) + " FROM counted",
    "category_scores": f"WITH {_SCORED} SELECT doc_id, " + ", ".join(f"s{i}" for i in N) + " FROM scored",
    "flagged_categories": (
        f"WITH {_SCORED} SELECT doc_id, {_flags('CAST(doc_id % 21 AS DOUBLE) / 20.0')} AS flagged FROM scored"
    ),
    "screen_verdict": (
        f"SELECT doc_id, safe, max_probability, engine FROM ({_screen('0.7')})"
    ),
    "screen_text": _screen(),
    "score_override": (
        f"WITH {_SCREEN_INPUT} SELECT doc_id, {_override('((doc_id + {i}) % 10) / 10.0')} FROM texts"
    ),
    "score_with_model": _model(),
    "score_with_model_bounded": _model(_FIRST_TOKENS),
    "scores_long": (
        f"WITH {_SCORED} " + " UNION ALL ".join(
            f"SELECT doc_id, {_text(CATEGORIES[i])} AS category, s{i} AS score FROM scored" for i in N)
    ),
    "screen_counters": (
        "SELECT count(*) AS total_requests, count(*) FILTER (NOT safe) AS blocked_requests,"
        " count(*) FILTER (engine = 'model') AS local_inferences,"
        " count(*) FILTER (engine = 'fallback') AS fallback_inferences,"
        f" count(*) FILTER (engine = 'empty_input') AS empty_inputs FROM ({_screen()})"
    ),
    "mask_email": _masked(_email),
    "mask_card": _masked(_card),
    "mask_ssn": _masked(_ssn),
    "mask_phone": _masked(_phone),
    "redact_text": _masked(_redact),
    "mask_sensitive_keys": (
        f"WITH {_PEOPLE} SELECT _id, account_balance, {_SECRET} AS password_hash, email, phone,"
        f" {_SECRET} AS api_token, credit_card || '|' || ssn AS cards, {_SECRET} AS secret_note,"
        f" 'call ' || phone AS note, phone AS line, {_SECRET} AS token_no FROM people"
    ),
    "redact_document": (
        f"WITH {_PEOPLE} SELECT _id, account_balance, {_SECRET} AS password_hash,"
        f" {_redacted_people(['email', 'phone'])}, {_SECRET} AS api_token,"
        f" {_redact('credit_card')} || '|' || {_redact('ssn')} AS cards, {_SECRET} AS secret_note,"
        f" 'call ' || {_redact('phone')} AS note, {_redact('phone')} AS line, {_SECRET} AS token_no FROM people"
    ),
    "redaction_flag": f"WITH {_DOCS} SELECT doc_id, text <> {_redact('text')} AS redaction_applied FROM docs",
    "redact_json": (
        f"WITH {_PEOPLE} SELECT _id, {_SECRET} AS password_hash, {_redacted_people(['email', 'phone'])},"
        f" {_SECRET} AS api_token, {_redact('credit_card')} AS card, {_SECRET} AS secret_note,"
        f" 'call ' || {_redact('phone')} AS note, {_SECRET} AS token_no, account_balance FROM people"
    ),
    "redaction_count": (
        f"WITH {_DOCS} SELECT count(*) FILTER (text <> {_redact('text')}) AS total_redactions FROM docs"
    ),
    "collection_counts": _INVENTORY,
    "read_collection": "SELECT * FROM customer",
    "guarded_read": (
        f"WITH {_PEOPLE}, bounded AS ({_ACTIVE}) SELECT CAST(_id AS VARCHAR) AS _id, name,"
        f" {_redacted_people(['email', 'phone', 'credit_card'])}, {_SECRET} AS password_hash,"
        f" account_balance, {_MASKED} AS redaction_applied FROM bounded"
    ),
    "guarded_read_summary": (
        f"WITH {_PEOPLE}, bounded AS ({_ACTIVE})"
        f" SELECT count(*) AS document_count, coalesce(bool_or({_MASKED}), false) AS redaction_applied FROM bounded"
    ),
    "filter_eq": (
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem"
        " WHERE l_returnflag = 'R' AND l_linestatus = 'F'"
    ),
    "filter_range": (
        f"WITH {_PURCHASES} SELECT transaction_id, amount, status FROM purchases WHERE amount < 50000.0"
    ),
    "project_include": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem",
    "project_exclude": f"WITH {_PEOPLE} SELECT * EXCLUDE (_id, ssn, password_hash) FROM people",
    "limit_50": (
        f"WITH {_PURCHASES} SELECT transaction_id, amount FROM purchases"
        " ORDER BY amount DESC, transaction_id LIMIT 50"
    ),
    "append_insert": f"WITH {_PURCHASES} SELECT * FROM purchases",
    "replace_table": f"WITH {_PURCHASES} SELECT * FROM purchases",
    "seed_if_empty": f"WITH {_PEOPLE} SELECT * FROM people",
    "guarded_delete": (
        f"WITH {_PURCHASES}, marked AS (SELECT *, status = 'failed' AND amount < 100000.0 AS gone FROM purchases)"
        " SELECT transaction_id, amount, status, (SELECT count(*) FROM marked WHERE gone) AS deleted_count"
        " FROM marked WHERE NOT gone"
    ),
    "rules_lookup": (
        f"WITH rules AS (SELECT {select_list(inputs.RULES)} FROM part)"
        " SELECT category, coalesce(description, '') AS description, coalesce(threat_level, '') AS threat_level,"
        " coalesce(playbook, action, '') AS action FROM rules WHERE category <> ''"
        " QUALIFY row_number() OVER (PARTITION BY category ORDER BY position DESC) = 1"
    ),
    "request_reads": (
        f"WITH {_FILTERED}, {_ANSWERS} SELECT request_id, collection, nth, CASE WHEN c = 0 AND NOT short AND NOT card THEN true"
        " WHEN short THEN false ELSE credit_card <> masked END AS redaction_applied,"
        " CASE WHEN c = 0 AND NOT card THEN _id END AS _id, CASE WHEN NOT short AND NOT card THEN user_id END AS user_id,"
        " CASE WHEN NOT short THEN masked END AS credit_card, CASE WHEN NOT card THEN status END AS status FROM answers"
    ),
    "gated_read": (
        f"WITH {_FILTERED}, {_ANSWERS}, flags AS (SELECT request_id, count(*) AS n, bool_or(NOT short"
        " AND ((c = 0 AND NOT card) OR credit_card <> masked)) AS redacted FROM answers GROUP BY request_id)"
        " SELECT request_id, CASE WHEN c = 4 THEN 'unknown_collection' WHEN kind = 6 THEN 'blocked'"
        " WHEN kind = 7 THEN 'unsupported_filter' ELSE 'allowed' END AS outcome, coalesce(n, 0) AS document_count,"
        " coalesce(redacted, false) AS redaction_applied FROM asked LEFT JOIN flags USING (request_id) WHERE op = 'read'"
    ),
    "gated_delete": (
        f"WITH {_FILTERED}, {_PURCHASES}, gone AS (SELECT transaction_id, min(request_id) AS request_id FROM purchases p, asked"
        f" WHERE op = 'delete' AND c = 1 AND kind <> 5 AND {_FITS_PURCHASES} GROUP BY transaction_id),"
        " counts AS (SELECT request_id, count(*) AS n FROM gone GROUP BY request_id)"
        " SELECT request_id, CASE WHEN c = 4 THEN 'unknown_collection' WHEN kind = 5 THEN 'empty_filter_refused'"
        " WHEN kind >= 6 THEN 'unsupported_filter' ELSE 'delete_allowed' END AS outcome, coalesce(n, 0) AS deleted,"
        " (SELECT count(*) FROM purchases) - (SELECT count(*) FROM gone) AS kept"
        " FROM asked LEFT JOIN counts USING (request_id) WHERE op = 'delete'"
    ),
    "snapshot_delete": (
        f"WITH {_PURCHASES}, marked AS (SELECT *, status = 'failed' AND amount < 100000.0 AS gone FROM purchases)"
        " SELECT transaction_id, amount, status, (SELECT count(*) FROM marked WHERE gone) AS deleted_count"
        " FROM marked WHERE NOT gone"
    ),
    "gen_users": (
        "SELECT * FROM (" + _values(CORE_USERS) + ") t(" + ", ".join(_user("c_custkey")) + ") UNION ALL SELECT "
        + ", ".join(f"{expr} AS {name}" for name, expr in _user("c_custkey").items()) + " FROM customer"
    ),
    "gen_transactions": (
        f"WITH {_DRAWN} SELECT * FROM ({_values(CORE_TRANSACTIONS)}) t({_TX_COLUMNS})"
        f" UNION ALL SELECT {_GENERATED_TRANSACTION} FROM drawn"
    ),
    "gen_logs": (
        f"SELECT * FROM ({_values(CORE_LOGS)}) t(log_id, level, message, timestamp, client_ip) UNION ALL SELECT"
        f" 'log_' || CAST(event_id + 100 AS VARCHAR), {_choice('event_id', 31, g.LOG_LEVELS)},"
        f" {_choice('event_id', 32, g.LOG_MESSAGES)}, {_before('event_id', 33)},"
        f" '192.168.1.' || {_number('event_id', 36, 2, 254)} FROM events"
    ),
    "audit_collection": (
        f"WITH {_REQUESTS} SELECT request_id, collection, {_IS_KNOWN} AS known FROM requests"
    ),
    "audit_json": (
        f"WITH {_REQUESTS} SELECT request_id, NOT json_valid({_given('query')}) AS bad_query,"
        f" NOT json_valid({_given('projection')}) AS bad_projection, NOT json_valid(document) AS bad_document,"
        " CASE WHEN json_valid(document) THEN json_type(document) = 'OBJECT' ELSE false END AS document_is_object"
        " FROM requests"
    ),
    "audit_operators": (
        f"WITH {_REQUESTS}, parsed AS (SELECT request_id, {_MINIFIED} AS minified FROM requests WHERE op = 'read')"
        f" SELECT request_id, {_OPERATOR} AS operator FROM parsed"
    ),
    "string_leaves": (
        f"WITH {_REQUESTS}, typed AS (SELECT requests.*, event_type FROM requests"
        " JOIN events ON event_id = request_id)"
        f" SELECT request_id, {_LEAVES} AS leaves FROM typed WHERE json_valid(document)"
    ).replace("user_id ||", "typed.user_id ||"),
    "audit_read": _decisions("read"),
    "audit_insert": _decisions("insert"),
    "audit_delete": _decisions("delete"),
    "insert_split": (
        f"WITH {_AUDIT} SELECT CASE WHEN security_alert THEN 'quarantine' ELSE 'accepted' END AS sink, request_id,"
        " collection, replace(document, ' ', '') AS document, event_type FROM audited"
        " WHERE op = 'insert' AND (security_alert OR outcome = 'approved')"
    ),
    "insert_again": (
        f"WITH {_AUDIT} SELECT CASE WHEN security_alert THEN 'quarantine' ELSE 'accepted' END AS sink, count(*) AS rows,"
        " CAST(sum(request_id) AS BIGINT) AS ids FROM audited WHERE op = 'insert' AND (outcome = 'approved' OR security_alert)"
        " GROUP BY security_alert"
    ),
    "insert_results": (
        f"WITH {_AUDIT} SELECT request_id, collection, substr(sha256(request_id || ':' || document), 1, 24)"
        f" AS inserted_id, {_redact('document')} AS document FROM audited WHERE op = 'insert' AND outcome = 'approved'"
    ),
    "violations": f"WITH {_AUDIT} {_VIOLATIONS}",
    "violations_latest": (
        f"WITH {_AUDIT} SELECT request_id, event_type, timestamp FROM ({_VIOLATIONS})"
        " ORDER BY timestamp DESC, request_id DESC"
    ),
    "violations_newest": f"WITH {_AUDIT} SELECT * FROM ({_VIOLATIONS}) ORDER BY timestamp DESC, request_id DESC LIMIT 100",
    "request_counters": f"WITH {_RESPONSES} SELECT {_PROCESSED} FROM responses",
    "latency_ms": f"WITH {_TIMED} SELECT request_id, latency_ms FROM timed",
    "avg_latency": (
        f"WITH {_TIMED} SELECT CAST(coalesce(floor(avg(latency_ms)), 0) AS BIGINT) AS avg_latency_ms FROM timed"
    ),
    "latency_rolling100": _ROLLING,
    "latency_last100": (
        f"WITH {_TIMED}, newest AS (SELECT latency_ms FROM timed ORDER BY started_at DESC, request_id DESC LIMIT 100)"
        " SELECT avg(latency_ms) AS avg_last, count(*) AS n_last FROM newest"
    ),
    "category_triggers": f"WITH {_TRIGGER_COUNTS} SELECT category, triggers FROM triggers",
    "category_share": (
        f"WITH {_TRIGGER_COUNTS} SELECT category, triggers, CAST(floor(100.0 * triggers /"
        " greatest((SELECT max(triggers) FROM triggers), 1) + 0.5) AS BIGINT) AS percent FROM triggers"
    ),
    "stats_row": (
        f"WITH {_RESPONSES}, inventory AS ({_INVENTORY}) SELECT {_PROCESSED}, {_REPORTED},"
        " CAST(floor(avg(latency_ms)) AS BIGINT) AS avg_latency_ms, count(engine) AS total_inferences,"
        " count(*) FILTER (engine = 'model') AS local_model_hits,"
        " count(*) FILTER (engine = 'fallback') AS fallback_hits,"
        " count(*) FILTER (engine = 'empty_input') AS empty_inputs, 'fallback' AS active_engine,"
        " (SELECT string_agg(collection || '=' || documents, '|' ORDER BY collection) FROM inventory)"
        " AS document_counts FROM responses"
    ),
    "blocked_total": (
        f"WITH {_AUDIT} SELECT {_REPORTED}, count(*) FILTER (security_alert) AS blocked_requests FROM audited"
    ),
    "stream_screen": _screen(more=f", {_redact('text')} AS text"),
    "stream_audit": f"WITH {_AUDIT} {_VIOLATIONS}",
    "stream_counters": _COUNTERS,
    "live_counters": _COUNTERS,
    "stream_rolling100": _ROLLING,
    "stream_violations_once": f"WITH {_AUDIT} {_VIOLATIONS}",
}
