"""DuckDB SQL of the numbered operators that SQL can express."""

from __future__ import annotations

from serion.llm.chat_format import ACCEPT, TRANSITIONS, Template
from serion.llm.importance import BUCKETS as IMPORTANCE_BUCKETS
from serion.llm.importance import MIN_WORDS as MIN_DRAW_WORDS
from serion.llm.importance import PERCENT, SEED
from serion.llm.quality_rules import MARKS, MAX_REPEAT_PERCENT, MIN_WORDS, REPEAT_WINDOW, RULES, STOP_WORDS
from serion.llm.queries import HOSTILE_CHAT
from serion.llm.substring_dedup import WINDOW
from serion.llm.url_filters import BLOCKED_HOSTS, LOWER_CASE, UPPER
from serion.llm.url_filters import RULES as URL_RULES
from serion.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

WORD = r"[^\x20\x09-\x0D]+"


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _quality() -> str:
    kept = ["NOT base_failed"]
    for r in RULES:
        ratio = f"(CASE WHEN {r.per} > 0 THEN {r.measure}::DOUBLE / {r.per} ELSE 0.0 END)"
        kept += [f"{ratio} >= {r.low}"] * (r.low is not None) + [f"{ratio} <= {r.high}"] * (r.high is not None)
    w = REPEAT_WINDOW
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT k, doc_id, t, regexp_extract_all(t, '{WORD}') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
win AS (SELECT k, s, hash(w[s:s + {w - 1}]) AS h FROM (SELECT k, w, unnest(range(1, len(w) - {w - 2})) AS s FROM p WHERE len(w) >= {w})),
rep AS (SELECT k, s FROM (SELECT k, s, count(*) OVER (PARTITION BY k, h) AS c FROM win) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT s + o) AS n FROM rep, range({w}) r(o) GROUP BY k),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(w, lambda x: list_contains([{", ".join(map(_quote, sorted(set(STOP_WORDS))))}], trim(lower(x), {_quote(MARKS)}))))::BIGINT AS n_stop_words
  FROM p LEFT JOIN cov USING (k)),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed, ({" AND ".join(kept)}) AS kept FROM b"""


def _urls() -> str:
    rules = sorted(URL_RULES, key=lambda r: -len(r.name))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in rules]
    rule = " ".join(f"WHEN {f} THEN '{r.name}'" for f, r in zip(fits, rules, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, rules, strict=True))
    listed = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in BLOCKED_HOSTS)
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER_CASE}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM s"""


def _chats() -> str:
    t, (conv, said) = Template(), HOSTILE_CHAT
    state = " ".join(f"WHEN a = '{a}' AND r = '{r}' THEN '{b}'" for (a, r), b in TRANSITIONS.items())
    loss = f"list_filter(turns, lambda x: x.role IN ({', '.join(map(_quote, t.loss_roles))}))"
    marks = len(t.open + t.mid + t.close)
    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({conv}, 0, 'user', {_quote(said)}), ({conv}, 1, 'assistant', {_quote(said)})),
g AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns,
  sum({marks} + length(role) + len(regexp_extract_all(role, '[\\<#:]')) + length(text) + len(regexp_extract_all(text, '[\\<#]'))) AS n FROM c GROUP BY conv_id),
o AS (SELECT *, array_to_string(list_transform({loss}, lambda x: x.text), '') AS loss,
  list_reduce(list_transform(turns, lambda x: x.role), lambda a, r: CASE {state} ELSE 'error' END, 'start') AS state FROM g)
SELECT conv_id, len(turns)::BIGINT AS n_turns,
  sha256(array_to_string(list_transform(turns, lambda x: x.role || chr(10) || x.text || chr(10)), '')) AS turns_sha256,
  length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, n::BIGINT AS formatted_chars, state IN ({", ".join(map(_quote, ACCEPT))}) AS valid FROM o"""


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _importance() -> str:
    # crc32 byte by byte: the table of 256 registers comes from eight halvings each
    return rf"""
WITH RECURSIVE halved AS (SELECT x::BIGINT AS byte, x::BIGINT AS c, 0 AS k FROM range(256) r(x)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM halved WHERE k < 8),
crcs AS (SELECT list(c ORDER BY byte) AS t FROM halved WHERE k = 8),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER_CASE}'), '{ALNUM}') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER_CASE}'), '{ALNUM}') AS w FROM benchmark),
dw AS (SELECT k, unnest(w) AS w FROM d), bw AS (SELECT unnest(w) AS w FROM b),
v AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
h AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || hex(encode(w))[2 * i + 1:2 * i + 2])::BIGINT)),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % {IMPORTANCE_BUCKETS} AS bucket FROM v, crcs),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN h USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN h USING (w) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {IMPORTANCE_BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {IMPORTANCE_BUCKETS}))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
m AS (SELECT k, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN h USING (w) JOIN g USING (bucket) GROUP BY 1),
c AS (SELECT d.k, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN m USING (k)),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM c WHERE n_features >= {MIN_DRAW_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * n // 100 THEN r END::BIGINT AS "rank" FROM c LEFT JOIN r USING (k)"""


def _codes() -> str:
    rounds = ""
    for k in range(ROUNDS + 1):
        rounds += f"""
d{k} AS MATERIALIZED (SELECT r, part, min({{'d': d, 'e': entry}}) AS m FROM (SELECT r, part, entry, sum((x.v - c{k}.v) * (x.v - c{k}.v))::BIGINT AS d FROM x JOIN c{k} USING (part, pos) GROUP BY ALL) GROUP BY ALL),"""
        if k < ROUNDS:
            rounds += f"""
c{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(n.v, c{k}.v) AS v FROM c{k} LEFT JOIN
  (SELECT part, m.e AS entry, pos, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v FROM x JOIN d{k} USING (r, part) GROUP BY ALL) n USING (part, entry, pos)),"""
    return f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
u AS (SELECT r, len(embedding) // {PARTS} AS wide, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM e),
x AS MATERIALIZED (SELECT r, i // wide AS part, i % wide AS pos, floor({SCALE} * v)::BIGINT AS v FROM u),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, v FROM x WHERE r <= {ENTRIES}),{rounds}
o AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM d{ROUNDS} GROUP BY 1),
b AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS h FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT h FROM b) AS codebooks_sha256 FROM e JOIN o USING (r)"""


def _repeats() -> str:
    n = WINDOW
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id, 9223372036854775807) AS i, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT k, i, s, array_to_string(w[s:s + {n - 1}], ' ') AS x FROM (SELECT k, i, w, unnest(range(1, len(w) - {n - 2})) AS s FROM d WHERE len(w) >= {n})),
hit AS (SELECT k, s FROM (SELECT k, i, s, min(i) OVER (PARTITION BY x) AS least FROM win) WHERE least < i),
gone AS (SELECT DISTINCT k, s + o AS pos FROM hit, range({n}) r(o)),
each AS (SELECT k, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT k, count(*) AS n, string_agg(x, ' ' ORDER BY pos) AS t FROM each ANTI JOIN gone USING (k, pos) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (k)"""


ORACLES: dict[str, str] = {
    "op5_quality_rules": _quality(),
    "op6_url_filters": _urls(),
    "op9_chat_format": _chats(),
    "op11_importance_resampling": _importance(),
    "op12_vector_codes": _codes(),
    "op13_substring_dedup": _repeats(),
}
