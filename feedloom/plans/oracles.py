"""The registered queries as SQL over the same tables.

The logic is written independently of the library code. Prompts, word lists and lengths are the library's own
constants; ``tests/test_constants.py`` pins their values.
"""

from __future__ import annotations

from feedloom.functions import answers, language, lexicon
from feedloom.plans.inputs import PHRASES, SINCE, SOURCE_OF_LANG

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"


def hashed(number: str, n: int) -> str:
    return f"(('0x' || substr(md5({number}::VARCHAR), 1, 8))::BIGINT % {n})"


def posted_at(number: str) -> str:
    return f"{AS_OF} - to_minutes({hashed(number, 43200)}) - to_microseconds({number})"


SINCE_SQL = f"TIMESTAMP '{SINCE}'"
SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NOT_SPACE = SPACE.replace("[", "[^", 1)
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def list_of(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def iso(expr: str, suffix: str = "Z") -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%f') || '{suffix}'"


# ---- text ----------------------------------------------------------------------

DECORATED = (
    "'RT @' || source || ': ' || text || CASE WHEN lang = 'fr' THEN ' e' || chr(769) ELSE '' END"
    " || ' https://ex.org/' || doc_id || ' ' || chr(128512) || chr(128640) || chr(160) || 'x'"
)


def no_urls(t: str) -> str:
    return f"regexp_replace({t}, 'https?://{NOT_SPACE}+', '', 'g')"


def no_emoji(t: str) -> str:
    return f"regexp_replace({t}, '{EMOJI}', '', 'g')"


def no_repost(t: str) -> str:
    return f"regexp_replace({t}, '^RT @[^:]+: ', '')"


def one_space(t: str) -> str:
    return f"trim(regexp_replace({t}, '{SPACE}+', ' ', 'g'))"


def normalized(t: str) -> str:
    return one_space(no_repost(no_emoji(no_urls(f"nfc_normalize({t})"))))


def cleaned(t: str) -> str:
    return normalized(t)


def on_decorated(expr: str) -> str:
    return f"WITH d AS (SELECT doc_id, {DECORATED} AS t FROM documents) SELECT doc_id, {expr} AS text FROM d"


def detected(t: str) -> str:
    """Language with the highest count of its stop words; the first named wins a tie."""
    words = rf"string_split_regex(lower({t}), '[^\pL]+')"
    counts = [
        f"len(list_filter(w, lambda x: list_contains({list_of(ws)}, x)))" for ws in language.PROFILES.values()
    ]
    all_counts = "[" + ", ".join(counts) + "]"
    names = list_of(language.PROFILES)
    return (
        f"(SELECT CASE WHEN list_max(n) > 0 THEN {names}[list_position(n, list_max(n))] END"
        f" FROM (SELECT {all_counts} AS n FROM (SELECT {words} AS w)))"
    )


TRUNCATE = f"""
WITH t AS (SELECT doc_id, text, string_split({one_space('text')}, ' ') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) <= 1500 THEN text ELSE array_to_string(w[1:1500], ' ') END AS text FROM t
"""

HASH = "sha256(source || '::' || text)"

DEDUP = f"""
WITH h AS (SELECT *, {HASH} AS content_hash FROM documents)
SELECT h.content_hash, h.doc_id, h.source, h.lang
FROM h JOIN (SELECT content_hash, min(doc_id) AS doc_id FROM h GROUP BY 1) USING (content_hash, doc_id)
"""

# ---- feeds ---------------------------------------------------------------------

EVENT_TEXT = (
    "'RT @' || event_type || ': user ' || user_id || ' was at the ' || event_type"
    " || ' https://ex.org/' || event_id || ' ' || chr(128512)"
)
EVENTS = (
    "(SELECT event_type AS source, event_id::VARCHAR AS source_id, user_id::VARCHAR AS author,"
    " ts AS published_at, props AS raw, event_id, user_id, value FROM events)"
)


def items_of(rows: str) -> str:
    """Feed rows (with ``body`` and ``given``) to items."""
    return f"""
WITH r AS ({rows}), c AS (SELECT *, {cleaned('body')} AS text FROM r)
SELECT source, source_id, author, {stamp('posted')} AS published_at,
       coalesce(nullif(given, ''), {detected('text')}) AS lang, text, raw
FROM c
"""


CHANNEL = items_of(f"""
SELECT 'telegram' AS source, event_type || ':' || event_id AS source_id, user_id::VARCHAR AS author, ts AS posted,
       NULL::VARCHAR AS given, CASE WHEN event_type = 'view' THEN '' ELSE {EVENT_TEXT} END AS body,
       to_json({{'channel': event_type, 'message': {{'id': event_id, 'date': {iso('ts', '')},
           'message': CASE WHEN event_type <> 'view' THEN {EVENT_TEXT} END, 'sender_id': user_id}}}})::VARCHAR AS raw
FROM events WHERE event_type <> 'error'""")

SEARCH_POST = items_of(f"""
SELECT 'twitter' AS source, event_id::VARCHAR AS source_id, user_id::VARCHAR AS author, ts AS posted,
       CASE WHEN event_type = 'click' THEN '' ELSE 'xx' END AS given, {EVENT_TEXT} AS body,
       to_json({{'id': event_id, 'text': {EVENT_TEXT}, 'lang': CASE WHEN event_type = 'click' THEN '' ELSE 'xx' END,
           'created_at': {iso('ts')}, 'author_id': user_id}})::VARCHAR AS raw
FROM events""")

SUBMISSION = items_of(f"""
SELECT 'reddit' AS source, CASE WHEN event_type = 'error' THEN event_id::VARCHAR ELSE 't3_' || event_id END AS source_id,
       user_id::VARCHAR AS author, date_trunc('second', ts) AS posted, NULL::VARCHAR AS given,
       CASE event_type WHEN 'view' THEN 'Title of view' WHEN 'signup' THEN '' ELSE {EVENT_TEXT} END AS body,
       to_json({{'id': event_id::VARCHAR, 'subreddit': event_type,
           'title': CASE WHEN event_type <> 'signup' THEN 'Title of ' || event_type END,
           'url': 'https://ex.org/' || event_id}})::VARCHAR AS raw
FROM events""")

STATUS = items_of(f"""
SELECT 'truth_social' AS source, event_id::VARCHAR AS source_id,
       CASE WHEN event_type <> 'view' THEN user_id::VARCHAR END AS author, ts AS posted,
       CASE WHEN event_type = 'click' THEN 'en' END AS given,
       CASE WHEN event_type = 'error' THEN '' ELSE {EVENT_TEXT} END AS body,
       to_json({{'id': event_id::VARCHAR, 'content': CASE WHEN event_type <> 'error' THEN {EVENT_TEXT} END,
           'language': CASE WHEN event_type = 'click' THEN 'en' END, 'created_at': {iso('ts')},
           'account': CASE WHEN event_type <> 'view' THEN {{'acct': user_id::VARCHAR}} END}})::VARCHAR AS raw
FROM events""")

LEARNED = rf"""
WITH w AS (SELECT doc_id, lang, ' ' || unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}]+'), lambda x: x <> '')) || ' ' AS p FROM documents),
g AS (SELECT doc_id, lang, unnest(flatten([{", ".join(f"list_transform(range(1, len(p) - {n - 2}), lambda i: substr(p, i, {n}))" for n in (3,))}])) AS gram FROM w),
t AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r
      FROM documents WHERE lang IS NOT NULL AND {hashed('doc_id', 5)} <> 0) WHERE r <= 2000),
c AS (SELECT lang, gram, count(*) AS n FROM g SEMI JOIN t USING (doc_id) GROUP BY ALL),
k AS (SELECT gram, sum(n) AS n FROM c GROUP BY gram HAVING sum(n) >= 2 ORDER BY n DESC, gram LIMIT 50000),
l AS (SELECT lang, sum(c.n)::DOUBLE + (SELECT count(*) FROM k) AS total FROM c SEMI JOIN k USING (gram) GROUP BY lang),
f AS (SELECT k.gram, l.lang, ln((coalesce(c.n, 0) + 1) / l.total) AS weight FROM k CROSS JOIN l LEFT JOIN c ON c.gram = k.gram AND c.lang = l.lang),
n AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT n.doc_id, l.lang, sum(n.n * coalesce(f.weight, ln(1 / l.total))) / sum(n.n) AS score
      FROM n CROSS JOIN l LEFT JOIN f ON f.gram = n.gram AND f.lang = l.lang GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS r FROM s)
SELECT d.doc_id, b.lang AS detected, round(b.score, 6) AS score FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND b.r = 1
"""

KEYWORDS = f"""
WITH r AS (SELECT doc_id::VARCHAR AS source_id, {posted_at('doc_id')} AS posted, lang, text FROM documents
           WHERE regexp_matches(lower(text), 'nicht|avec|which| ist | les ')),
n AS (SELECT *, row_number() OVER (ORDER BY posted DESC, source_id) AS rn FROM r WHERE posted >= TIMESTAMP '2024-01-20 00:00:00')
SELECT source_id, {stamp('posted')} AS published_at, lang, {cleaned('text')} AS text FROM n WHERE rn <= 100
"""

NEWEST = f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, source_id) AS rn FROM {EVENTS})
SELECT source, source_id, {stamp('published_at')} AS published_at FROM n WHERE rn <= 100 AND published_at > {SINCE_SQL}
"""

UNION = """
SELECT role AS source, conv_id || ':' || turn AS source_id, text, NULL::VARCHAR AS lang, NULL::VARCHAR AS raw FROM conversations
UNION ALL SELECT source, doc_id::VARCHAR, text, lang, NULL FROM documents
UNION ALL SELECT event_type, event_id::VARCHAR, NULL, NULL, props FROM events
"""

VIOLATIONS = f"""
WITH r AS (
  SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN source END AS source,
         CASE WHEN event_id % 89 = 0 THEN repeat(source_id, 260) WHEN value < 30 THEN (event_id - event_id % 83 % 2)::VARCHAR END AS source_id,
         CASE WHEN value > 20 THEN repeat(author, 200) ELSE author END AS author,
         CASE WHEN event_id % 79 <> 0 THEN published_at END AS published_at,
         CASE WHEN source = 'signup' THEN 'en-GB-x' ELSE 'en' END AS lang,
         CASE WHEN event_id % 73 <> 0 THEN '' END AS text,
         CASE WHEN event_id % 71 = 0 THEN 'very undecided indeed' ELSE 'neutral' END AS stance,
         CASE WHEN value >= 2 THEN raw END AS raw FROM {EVENTS}),
c AS (SELECT source, source_id FROM r WHERE source IS NOT NULL AND source_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
v AS (
  SELECT event_id, list_sort(list_filter([
    CASE WHEN r.source IS NULL THEN 'source missing' END,
    CASE WHEN r.source_id IS NULL THEN 'source_id missing' END,
    CASE WHEN published_at IS NULL THEN 'published_at missing' END,
    CASE WHEN text IS NULL THEN 'text missing' END,
    CASE WHEN raw IS NULL THEN 'raw missing' END,
    CASE WHEN length(r.source_id) > 255 THEN 'source_id longer than 255' END,
    CASE WHEN length(author) > 255 THEN 'author longer than 255' END,
    CASE WHEN length(lang) > 5 THEN 'lang longer than 5' END,
    CASE WHEN length(stance) > 16 THEN 'stance longer than 16' END,
    CASE WHEN r.source NOT IN ('click', 'view', 'purchase', 'signup') THEN 'source unknown' END,
    CASE WHEN c.source IS NOT NULL THEN 'repeated key' END], lambda x: x IS NOT NULL)) AS broken
  FROM r LEFT JOIN c ON r.source = c.source AND r.source_id = c.source_id)
SELECT event_id, array_to_string(broken, '; ') AS violations FROM v WHERE len(broken) > 0
"""

# ---- marks, upsert, cache --------------------------------------------------------

COUNTS = f"SELECT source, count(DISTINCT {HASH}) AS n_items FROM documents GROUP BY 1"

RESUME = f"""
WITH names AS (SELECT event_type AS source FROM events UNION SELECT source FROM documents),
m AS (SELECT event_type AS source, max(ts) AS mark FROM events GROUP BY 1)
SELECT source, {stamp(f"coalesce(CASE WHEN source = 'click' THEN {SINCE_SQL} END, mark, {AS_OF} - to_seconds(240))")} AS since
FROM names LEFT JOIN m USING (source)
"""

UPSERT = f"""
WITH e AS (SELECT *, published_at <= {SINCE_SQL} AS old FROM {EVENTS}),
u AS (SELECT author, bool_or(old) AS had, bool_and(old) AS only_old,
             arg_max({{'source': source, 'source_id': source_id, 'raw': raw, 'posted': published_at}}, (published_at, event_id)) AS w
      FROM e GROUP BY 1)
SELECT author, w.source AS source, w.source_id AS source_id, w.raw AS raw, {stamp('w.posted')} AS published_at,
       {stamp(f'CASE WHEN had THEN {SINCE_SQL} ELSE {AS_OF} END')} AS created_at,
       {stamp(f'CASE WHEN only_old THEN {SINCE_SQL} ELSE {AS_OF} END')} AS updated_at
FROM u
"""

LABELLED_ROWS = """
a AS (SELECT vec_id AS n, ['telegram', 'twitter', 'reddit', 'truth_social'][label % 4 + 1] AS source, 'v' || vec_id AS source_id, 'vector ' || vec_id AS text,
    CASE WHEN label = 9 THEN NULL WHEN label % 3 = 0 AND label % 4 <> 3
      THEN ['crypto', 'macro', 'regulation', 'markets'][label % 4 + 1] || ',markets'
      ELSE ['crypto', 'macro', 'regulation', 'markets'][label % 4 + 1] END AS topics,
    (vec_id % 3 - 1)::INTEGER AS sentiment, ['bearish', 'neutral', 'bullish'][vec_id % 3 + 1] AS stance, (vec_id % 3)::INTEGER AS impact FROM embeddings),
a1 AS (SELECT *, 'T' || stance AS tickers FROM a),
b1 AS (SELECT n, CASE WHEN n % 4 = 0 THEN 'reddit' ELSE source END AS source, source_id, CASE WHEN n % 8 = 0 THEN 'edited' ELSE text END AS text,
    CASE WHEN n % 6 <> 0 THEN topics END AS topics, CASE WHEN n % 6 <> 0 THEN sentiment END AS sentiment,
    CASE WHEN n % 6 <> 0 THEN stance END AS stance, CASE WHEN n % 6 <> 0 THEN impact END AS impact,
    CASE WHEN n % 6 <> 0 THEN tickers END AS tickers FROM a1 WHERE n % 2 = 0)"""

UPSERT_LABELLED = f"""
WITH {LABELLED_ROWS},
i AS (SELECT 'id' AS mode, CASE WHEN b.n IS NULL THEN a ELSE b END AS w, a.n IS NOT NULL AS had,
        b.n IS NOT NULL AND (b.n % 6 = 0 OR b.n % 8 = 0 OR b.source <> a.source) AS changed, true AS old
      FROM a1 a LEFT JOIN b1 b ON a.source_id = b.source_id),
j AS (SELECT a.*, b.n AS bn, b.text AS btext FROM a1 a LEFT JOIN b1 b ON a.source_id = b.source_id AND a.source = b.source),
p AS (SELECT 'pair' AS mode, source, source_id, coalesce(btext, text) AS text, topics, tickers, sentiment, stance, impact,
        true AS old, bn IS NOT NULL AND btext <> text AS changed FROM j
      UNION ALL SELECT 'pair', b.source, b.source_id, b.text, b.topics, b.tickers, b.sentiment, b.stance, b.impact, false, true
      FROM b1 b JOIN a1 a ON a.source_id = b.source_id WHERE a.source <> b.source),
u AS (SELECT mode, w.source AS source, w.source_id AS source_id, w.text AS text, w.topics AS topics, w.tickers AS tickers,
        w.sentiment AS sentiment, w.stance AS stance, w.impact AS impact, old, changed FROM i
      UNION ALL SELECT * FROM p)
SELECT mode, source, source_id, text, topics, tickers, sentiment, stance, impact,
  {stamp(f'CASE WHEN old THEN {SINCE_SQL} ELSE {AS_OF} END')} AS created_at,
  {stamp(f'CASE WHEN changed THEN {AS_OF} ELSE {SINCE_SQL} END')} AS updated_at FROM u
"""

LATE_ROWS = f"""
WITH b AS (SELECT event_type, max(ts) AS mark FROM events WHERE event_id % 2 = 0 AND ts <= {SINCE_SQL} GROUP BY 1)
SELECT event_type AS source, count(*) FILTER (WHERE mark IS NULL OR ts > mark) AS n_new, count(*) FILTER (WHERE ts <= mark) AS n_late
FROM events LEFT JOIN b USING (event_type) WHERE event_id % 2 = 1 GROUP BY 1
"""

HITS = f"""
WITH h AS (SELECT *, {HASH} AS content_hash FROM documents),
c AS (SELECT content_hash, arg_max(n_chars, doc_id) AS n FROM h WHERE lang = 'en' GROUP BY 1)
SELECT doc_id, content_hash, n::DOUBLE AS first_value FROM h JOIN c USING (content_hash)
"""

MISSES = f"""
WITH h AS (SELECT *, {HASH} AS content_hash FROM documents)
SELECT content_hash, count(*) AS n_items FROM h
WHERE length(text) > 0 AND content_hash NOT IN (SELECT content_hash FROM h WHERE lang = 'en') GROUP BY 1
"""

# ---- answers and prompts ---------------------------------------------------------

STANCE = "['bullish', 'bearish', 'neutral'][user_id % 3 + 1]"
HEAD = f"""'"sentiment":' || (event_id % 3 - 1) || ',"stance":"' || {STANCE} || '","impact":' || (user_id % 3)"""
FULL = "event_id % 10 = 0"
VALID = "event_id % 10 IN (0, 1)"
LABELS = f"""
CASE WHEN {VALID} THEN (event_id % 3 - 1)::INTEGER END AS sentiment,
CASE WHEN {VALID} THEN {STANCE} END AS stance,
CASE WHEN {VALID} THEN (user_id % 3)::INTEGER END AS impact"""

PARSED = f"""
SELECT event_id, {VALID} AS valid,
  CASE WHEN {FULL} THEN 'crypto,' || event_type WHEN {VALID} THEN '' END AS topics,
  CASE WHEN {FULL} THEN 'T' || user_id WHEN {VALID} THEN '' END AS tickers,
  CASE WHEN {FULL} THEN 'ORG=' || event_type WHEN {VALID} THEN '' END AS entities, {LABELS}
FROM events
"""

FLAT = f"""
SELECT event_id, CASE WHEN {FULL} THEN 'crypto,' || event_type ELSE '' END AS topics,
  CASE WHEN {FULL} THEN 'T' || user_id ELSE '' END AS tickers,
  CASE WHEN {FULL} THEN 1 ELSE 0 END AS n_entities, {LABELS}
FROM events
"""

REJECTED = f"""
SELECT event_id, CASE event_id % 10
  WHEN 2 THEN 'not json'
  WHEN 3 THEN '{{' || {HEAD} || '}} trailing'
  WHEN 4 THEN '{{' || {HEAD} || ',"topics":null}}'
  WHEN 5 THEN '{{' || {HEAD} || ',"topics":["a",3]}}'
  WHEN 6 THEN '{{' || {HEAD} || ',"entities":[{{"type":"ORG"}}]}}'
  WHEN 7 THEN '{{"sentiment":"' || (event_id % 3 - 1) || '","stance":"' || {STANCE} || '","impact":' || (user_id % 3) || '}}'
  WHEN 8 THEN '{{"sentiment":' || (event_id % 3 - 1) || ',"stance":"up","impact":' || (user_id % 3) || '}}'
  ELSE '[{{' || {HEAD} || '}}]' END AS answer
FROM events WHERE NOT ({VALID})
"""

USER_TURN = f"{quoted(answers.USER_PROMPT_HEAD)} || %s || {quoted(answers.USER_PROMPT_TAIL)}"

PROMPT = f"""
SELECT doc_id, 0 AS turn, 'system' AS role, {quoted(answers.SYSTEM_PROMPT)} AS content FROM documents
UNION ALL SELECT doc_id, 1, 'user', {USER_TURN % 'text'} FROM documents
"""

REPAIR = f"""
WITH r AS ({REJECTED})
SELECT event_id, 0 AS turn, 'system' AS role, {quoted(answers.SYSTEM_PROMPT)} AS content FROM r
UNION ALL SELECT event_id, 1, 'user', {USER_TURN % 'answer'} FROM r
UNION ALL SELECT event_id, 2, 'user', {quoted(answers.REPAIR_PROMPT)} FROM r
"""

CHUNKS = """
WITH p AS (SELECT source, doc_id, n_chars, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 50 AS chunk_id FROM documents)
SELECT source, chunk_id, count(*)::INTEGER AS n, string_agg(n_chars::VARCHAR, ',' ORDER BY doc_id) AS sizes FROM p GROUP BY 1, 2
"""

# ---- models ----------------------------------------------------------------------

TWO_PASS = """
WITH k AS (SELECT doc_id, length(text) AS n, length(text) % 4 AS kind FROM documents)
SELECT doc_id, n > 0 AND kind IN (1, 2) AS asked_twice,
  CASE WHEN n > 0 AND kind < 2 THEN (n % 3 - 1)::INTEGER END AS sentiment,
  CASE WHEN n > 0 AND kind < 2 THEN (n % 3)::INTEGER END AS impact,
  CASE WHEN n > 0 AND kind < 2 THEN 'T' || n END AS tickers,
  CASE WHEN n > 0 THEN CASE kind WHEN 2 THEN 'answer does not match the schema'
                                 WHEN 3 THEN 'RuntimeError: no connection' END END AS error
FROM k
"""


def lexicon_labels(source: str, carried: str) -> str:
    """Labels of the texts ``t`` of ``source``; ``carried`` columns are passed on."""
    topics = ", ".join(
        f"CASE WHEN list_has_any(w, {list_of(words)}) THEN {quoted(name)} END" for name, words in lexicon.TOPIC_WORDS.items()
    )
    good = f"len(list_filter(w, lambda x: list_contains({list_of(lexicon.POSITIVE_WORDS)}, x)))"
    bad = f"len(list_filter(w, lambda x: list_contains({list_of(lexicon.NEGATIVE_WORDS)}, x)))"
    names = "|".join(lexicon.ORGANISATIONS)
    return rf"""
SELECT {carried}, array_to_string(list_filter([{topics}], lambda x: x IS NOT NULL), ',') AS topics,
  sign(s)::INTEGER AS sentiment, CASE WHEN s > 0 THEN 'bullish' WHEN s < 0 THEN 'bearish' ELSE 'neutral' END AS stance,
  least(abs(s), 2)::INTEGER AS impact,
  array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\$([A-Z]{{2,5}})\b', 1))), ',') AS tickers,
  list_sort(list_distinct(regexp_extract_all(t, '\b({names})\b', 1))) AS orgs
FROM (SELECT *, {good} - {bad} AS s FROM (SELECT *, string_split_regex(lower(t), '[^\pL\pN]+') AS w FROM {source}))
"""


def phrase(number: str) -> str:
    return f"{list_of(PHRASES)}[{number} % {len(PHRASES)} + 1]"


LEXICON = f"""
WITH p AS (SELECT doc_id, text || ' ' || {phrase('doc_id')} AS t FROM documents),
l AS ({lexicon_labels('p', 'doc_id')})
SELECT doc_id, topics, sentiment, stance, impact, tickers,
  array_to_string(list_transform(orgs, lambda x: 'ORG=' || x), ',') AS entities FROM l
"""


def bucket_weights(source: str, key: str) -> str:
    """Non-zero entries (key, dim, weight) of the hashed bags of words of texts ``t``."""
    return rf"""
SELECT {key}, dim, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS weight FROM (
  SELECT {key}, (('0x' || substr(md5(w), 1, 8))::BIGINT % 64)::INTEGER AS dim, count(*)::DOUBLE AS n
  FROM (SELECT {key}, unnest(string_split_regex(lower(t), '[^\pL\pN]+')) AS w FROM {source}) WHERE w <> '' GROUP BY 1, 2)
"""


EMBED = f"""
SELECT doc_id, dim, round(weight, 6) AS weight
FROM ({bucket_weights('(SELECT doc_id, text AS t FROM documents)', 'doc_id')})
"""

EMBED_DISTINCT = f"""
WITH d AS (SELECT {HASH} AS content_hash, min(text) AS t FROM documents GROUP BY 1),
b AS ({bucket_weights('d', 'content_hash')})
SELECT content_hash, CASE WHEN min(d.t) = '' THEN NULL ELSE 64 END AS dim,
  CASE WHEN min(d.t) <> '' THEN round(coalesce(sum(weight * (dim + 1)), 0), 4) END AS total
FROM d LEFT JOIN b USING (content_hash) GROUP BY 1
"""

# ---- vectors and search ------------------------------------------------------------


def cosine(a: str, b: str) -> str:
    x, y = f"{a}::DOUBLE[]", f"{b}::DOUBLE[]"
    norms = f"(sqrt(list_dot_product({x}, {x})) * sqrt(list_dot_product({y}, {y})))"
    return f"CASE WHEN {norms} = 0 THEN 0 ELSE list_dot_product({x}, {y}) / {norms} END"


SOURCE_LIST = list_of(SOURCE_OF_LANG.values())
SOURCE_CASE = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCE_OF_LANG.items()) + " END"
ITEMS = f"""
v AS (
  SELECT {SOURCE_LIST}[label % 4 + 1] AS source, 'v' || vec_id AS source_id, {AS_OF} - to_hours({hashed('vec_id', 720)}) AS published_at,
    CASE WHEN label = 9 THEN NULL
         WHEN label % 3 = 0 AND label % 4 <> 3 THEN [['crypto', 'macro', 'regulation', 'markets'][label % 4 + 1], 'markets']
         ELSE [['crypto', 'macro', 'regulation', 'markets'][label % 4 + 1]] END AS topics,
    (vec_id % 3 - 1)::INTEGER AS sentiment, ['bearish', 'neutral', 'bullish'][vec_id % 3 + 1] AS stance,
    'vector ' || vec_id AS text, embedding FROM embeddings),
i AS (
  SELECT * FROM v UNION ALL
  SELECT {SOURCE_CASE}, 'd' || doc_id, {posted_at('doc_id')}, NULL, NULL, NULL,
         '{{"doc_id":' || doc_id || ',"n_chars":' || n_chars || '}}', NULL FROM documents),
q AS (SELECT arg_min(embedding, vec_id) AS q FROM embeddings)"""


def top(where: str, limit: int, columns: str) -> str:
    return f"""
WITH {ITEMS}, s AS (SELECT i.*, round({cosine('embedding', 'q')}, 12) AS score FROM i, q WHERE len(embedding) > 0 AND {where})
SELECT {columns} FROM (SELECT * FROM s ORDER BY score DESC, source_id LIMIT {limit})
"""


HIT = "source_id, round(score, 6) AS score"

COSINE = f"""
WITH f AS (SELECT label, arg_min(embedding, vec_id) AS first FROM embeddings GROUP BY 1)
SELECT vec_id, label, round({cosine('embedding', 'first')}, 6) AS score FROM embeddings JOIN f USING (label)
"""

MULTI = f"""
WITH {ITEMS}, f AS (SELECT vec_id AS query_id, embedding AS first FROM embeddings WHERE vec_id % 100 = 0 AND len(embedding) > 0),
s AS (SELECT query_id, source_id, round({cosine('embedding', 'first')}, 12) AS score FROM i, f WHERE len(embedding) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank FROM s)
SELECT query_id, source_id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10
"""

# ---- everything ------------------------------------------------------------------

SEARCH_TEXT = f"""
WITH p AS (
  SELECT {SOURCE_CASE} AS source, doc_id::VARCHAR AS source_id, {posted_at('doc_id')} AS published_at,
    text || ' ' || {phrase('doc_id')} AS t FROM documents),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, t ORDER BY published_at DESC, source_id) AS rn FROM p) WHERE rn = 1),
l AS ({lexicon_labels('k', 'source, source_id, published_at, t')}),
q AS (SELECT 0 AS one, 'bitcoin rally after ETF approval' AS t),
qw AS ({bucket_weights('q', 'one')}),
w AS ({bucket_weights('(SELECT * FROM k WHERE published_at >= ' + AS_OF + ' - to_days(3))', 'source_id')}),
s AS (SELECT w.source_id, round(sum(w.weight * coalesce(qw.weight, 0)) / (sqrt(sum(w.weight * w.weight)) * (SELECT sqrt(sum(weight * weight)) FROM qw)), 12) AS score
      FROM w LEFT JOIN qw USING (dim) GROUP BY 1)
SELECT source || ':' || source_id AS item, round(score, 3) AS score, topics, sentiment, stance, t AS text
FROM l JOIN s USING (source_id) WHERE stance = 'bullish' ORDER BY s.score DESC, source_id LIMIT 10
"""

def enriched(earlier: str) -> str:
    """Items after a first batch of the documents that ``earlier`` holds for and a second one of all."""
    return f"""
WITH p AS (
  SELECT doc_id, {SOURCE_CASE} AS source, doc_id::VARCHAR AS source_id, d.source AS author,
    {posted_at('doc_id')} AS published_at, {cleaned(DECORATED.replace('source', 'd.source') + " || ' ' || " + phrase('doc_id'))} AS t,
    '{{"doc_id":' || doc_id || ',"n_chars":' || n_chars || '}}' AS raw FROM documents d),
h AS (SELECT *, sha256(source || '::' || t) AS content_hash FROM p),
e AS (SELECT source_id FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY published_at DESC, source_id) AS rn FROM h WHERE {earlier}) WHERE rn = 1),
n AS (SELECT source_id FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY published_at DESC, source_id) AS rn FROM h) WHERE rn = 1),
k AS (SELECT h.*, source_id IN (SELECT source_id FROM e) AS old FROM h
      WHERE source_id IN (SELECT source_id FROM e UNION SELECT source_id FROM n)),
l AS ({lexicon_labels('k', 'source, source_id, author, published_at, t, raw, old')}),
b AS (SELECT source_id, round(sum(weight * (dim + 1)), 4) AS total FROM ({bucket_weights('k', 'source_id')}) GROUP BY 1),
m AS (SELECT *, md5(source || chr(31) || source_id) AS x FROM l JOIN b USING (source_id))
SELECT substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-' || substr(x, 13, 4) || '-' || substr(x, 17, 4) || '-' || substr(x, 21, 12) AS id,
  source, source_id, author, {stamp('published_at')} AS published_at, {detected('t')} AS lang, t AS text, raw,
  topics, sentiment, stance, impact, tickers, len(orgs)::INTEGER AS n_entities, 64 AS dim, total,
  {stamp(f'CASE WHEN old THEN {SINCE_SQL} ELSE {AS_OF} END')} AS created_at, {stamp(f'CASE WHEN old THEN {SINCE_SQL} ELSE {AS_OF} END')} AS updated_at
FROM m
"""


QUARTERS = "date_trunc('second', ts) + to_milliseconds(event_id % 4 * 250)"

SQL: dict[str, str] = {
    "normalize_text": on_decorated(normalized("t")),
    "strip_urls": on_decorated(no_urls("t")),
    "strip_emoji": on_decorated(no_emoji("t")),
    "strip_rt_prefix": on_decorated(no_repost("t")),
    "collapse_whitespace": on_decorated(one_space("t")),
    "truncate_tokens": TRUNCATE,
    "ensure_max_length": "SELECT doc_id, CASE WHEN length(text) <= 280 THEN text ELSE left(text, 279) || chr(8230) END AS text FROM documents",
    "detect_language": f"SELECT doc_id, {detected('text')} AS detected FROM documents",
    "detect_language_learned": LEARNED,
    "content_hash": f"SELECT doc_id, {HASH} AS content_hash FROM documents",
    "dedup_keep_first": DEDUP,
    "parse_iso8601": f"""SELECT event_id, {stamp("CASE event_type WHEN 'click' THEN ts WHEN 'view' THEN ts WHEN 'purchase' THEN ts - to_hours(3) WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN date_trunc('day', ts) WHEN event_id % 60 BETWEEN 1 AND 52 THEN TIMESTAMP '2024-01-03 10:30:00' + to_days(7 * (event_id % 60 - 1)::INTEGER) END END")} AS parsed FROM events""",
    "epoch_to_timestamp": f"""SELECT event_id, {stamp(QUARTERS)} AS "at",
        CASE WHEN event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE {iso(QUARTERS)} END AS iso,
        CASE WHEN date_trunc('second', ts) = ts THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE {iso('ts')} END AS iso_exact FROM events""",
    "map_channel_message": CHANNEL,
    "map_search_post": SEARCH_POST,
    "map_submission": SUBMISSION,
    "map_status": STATUS,
    "ingest_since": f"SELECT source, source_id, author, {stamp('published_at')} AS published_at, raw FROM {EVENTS} WHERE published_at > {SINCE_SQL}",
    "ingest_keyword_or": KEYWORDS,
    "newest_n_per_feed": NEWEST,
    "union_sources": UNION,
    "enabled_sources": f"SELECT source, source_id, raw FROM {EVENTS} WHERE source IN ('click', 'view')",
    "reject_unknown_source": f"SELECT source, source_id, raw FROM {EVENTS} WHERE source NOT IN ('click', 'view', 'purchase', 'signup')",
    "constraint_violations": VIOLATIONS,
    "high_water_marks": f"SELECT event_type AS source, {stamp('max(ts)')} AS mark FROM events GROUP BY 1",
    "batch_counts": COUNTS,
    "resume_points": RESUME,
    "upsert_last_wins": UPSERT,
    "upsert_labelled": UPSERT_LABELLED,
    "late_rows": LATE_ROWS,
    "lookup_by_source_id": "SELECT url AS source_id, page_id FROM pages WHERE url = (SELECT arg_min(url, page_id) FROM pages)",
    "embedding_cache_hits": HITS,
    "embedding_cache_misses": MISSES,
    "parse_classification": PARSED,
    "flatten_classification": FLAT,
    "parse_vector_json": """SELECT vec_id, CASE WHEN label <> 3 THEN len(embedding)::INTEGER END AS dim,
        CASE WHEN label <> 3 THEN round(list_sum(embedding::DOUBLE[]), 6) END AS total FROM embeddings""",
    "render_prompt": PROMPT,
    "render_repair_prompt": REPAIR,
    "chunk_batches": CHUNKS,
    "classify_two_pass": TWO_PASS,
    "classify_lexicon": LEXICON,
    "embed_hashing": EMBED,
    "embed_texts": EMBED_DISTINCT,
    "cosine_similarity": COSINE,
    "semantic_search": top("true", 20, HIT),
    "search_filtered": top("sentiment = 1 AND stance = 'bullish' AND list_has_any(topics, ['crypto', 'markets'])", 20, HIT),
    "search_recent": top(f"sentiment = 0 AND published_at >= {AS_OF} - to_days(7)", 20, HIT),
    "search_result_view": top(
        "true", 10,
        "source || ':' || source_id AS item, round(score, 3) AS score, coalesce(array_to_string(topics, ','), '') AS topics, sentiment, stance, text",
    ),
    "topic_overlap": f"WITH {ITEMS} SELECT source_id, coalesce(list_has_any(topics, ['crypto', 'macro']), false) AS overlaps FROM i",
    "semantic_search_multi": MULTI,
    "search_indexed": MULTI,
    "search_by_topic": top("sentiment = 1 AND coalesce(list_has_any(topics, ['macro', 'regulation']), false)", 20, HIT),
    "search_text": SEARCH_TEXT,
    "enrich_items": enriched("false"),
    "enrich_into_store": enriched("doc_id % 5 = 0"),
}
