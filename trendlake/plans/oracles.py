"""DuckDB SQL for the queries of queries.py, over the driver's tables."""

from __future__ import annotations

import re

from ..constants import ENTITIES, EVENT_TYPES, METRICS, ROLES, SOURCES, STOP_WORDS

_SOURCES = ", ".join(f"'{s}'" for s in SOURCES)
_ROLE = "CASE source_type " + " ".join(f"WHEN '{s}' THEN '{r}'" for s, r in ROLES.items()) + " ELSE 'PRIMARY' END"

_HEADS = ", ".join(f"'{h}'" for h in ("OpenAI launches GPT-5: ", "Anthropic ships Claude Code - ", "Breaking: Meta open-source Llama 3. ", "NVIDIA raises funding: ", "", "", "", "", ""))

ITEMS = rf"""
items AS (
  SELECT doc_id AS hot_item_id, list_extract([{_SOURCES}], CAST(doc_id % 10 + 1 AS INT)) AS source_type, CAST(doc_id AS VARCHAR) AS external_id,
    list_extract([{_HEADS}], CAST(doc_id % 9 + 1 AS INT)) || regexp_extract(text, '^[^.!?\n]*[.!?]?') AS title, text AS summary,
    CASE doc_id % 6 WHEN 0 THEN 'https://arxiv.org/abs/2401.' || lpad(CAST(doc_id % 500 AS VARCHAR), 5, '0')
      WHEN 1 THEN 'https://github.com/org' || (doc_id % 20) || '/repo' || (doc_id % 50) WHEN 2 THEN 'https://huggingface.co/org' || (doc_id % 20) || '/model' || (doc_id % 50)
      WHEN 3 THEN 'https://news.ycombinator.com/item?id=' || (doc_id % 300) WHEN 4 THEN 'https://twitter.com/u' || (doc_id % 30) || '/status/' || (doc_id % 400)
      ELSE 'HTTPS://Example.COM:443/p/' || (doc_id % 100) || '?utm_source=x&b=2&a=1#frag' END AS source_url,
    source AS author, n_chars % 700 AS points, doc_id % 250 AS comments_count, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(10 * doc_id) AS published_at
  FROM documents),
membership AS (
  SELECT hot_item_id // 4 AS hot_cluster_id, hot_item_id, hot_item_id % 4 = 0 AS is_primary, published_at AS assigned_at, CASE WHEN hot_item_id % 7 = 6 THEN published_at END AS removed_at FROM items),
clusters AS (
  SELECT hot_item_id // 4 AS hot_cluster_id, arg_min(title, hot_item_id) AS title, arg_min(summary, hot_item_id) AS summary, min(published_at) AS first_seen_at, max(published_at) AS last_seen_at,
    CASE WHEN (hot_item_id // 4) % 11 = 10 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status FROM items GROUP BY hot_item_id // 4),
members AS (SELECT m.hot_cluster_id, m.is_primary, m.assigned_at, i.* FROM membership m JOIN items i USING (hot_item_id) WHERE m.removed_at IS NULL)"""

V1 = """
agg AS (SELECT hot_cluster_id, max(points) AS points, max(comments_count) AS comments, max(published_at) AS newest, count(*) AS n FROM members GROUP BY hot_cluster_id),
parts AS (
  SELECT hot_cluster_id, ln(1 + least(500.0, greatest(0, points))) / ln(501.0) * 35 AS points_score, ln(1 + least(200.0, greatest(0, comments))) / ln(201.0) * 20 AS comments_score,
    greatest(0.0, 1 - floor(greatest(0, epoch_us(TIMESTAMP '2024-03-15 00:00:00') - epoch_us(newest)) / 3600000000.0) / 72.0) * 30.0 AS freshness_score, CAST(4.0 AS DOUBLE) AS keyword_score, least(5.0, 2.5 * (n - 1)) AS evidence_score FROM agg),
scores AS (SELECT *, round(points_score + comments_score + freshness_score + keyword_score + evidence_score, 4) AS total_score FROM parts)"""

_W = "WITH " + ITEMS.lstrip()
ORACLES: dict[str, str] = {}

ORACLES["score_v1_ranking"] = f"""{_W}, {V1}
SELECT s.hot_cluster_id, s.total_score, round(points_score, 6) AS points_score, round(comments_score, 6) AS comments_score, round(freshness_score, 6) AS freshness_score, keyword_score, CAST(evidence_score AS DOUBLE) AS evidence_score
FROM scores s JOIN clusters c USING (hot_cluster_id) ORDER BY total_score DESC, last_seen_at DESC, hot_cluster_id DESC LIMIT 50"""
ORACLES["score_v1_all"] = f"{_W}, {V1} SELECT hot_cluster_id, total_score FROM scores"

ORACLES["url_functions"] = r"""
WITH p AS (SELECT page_id, trim(url) AS url, regexp_extract(trim(url), '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', ['scheme', 'host', 'path', 'query', 'frag']) AS u FROM pages),
q AS (SELECT *, list_filter(string_split(substring(u.query, 2), '&'), lambda x: x <> '') AS parts FROM p),
k AS (SELECT *, array_to_string(list_sort(list_filter(parts, lambda x: NOT starts_with(lower(split_part(x, '=', 1)), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN ('ref', 'source', 'fbclid', 'gclid'))), '&') AS kept,
  array_to_string(list_filter(parts, lambda x: lower(split_part(x, '=', 1)) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'msclkid', 'ref')), '&') AS safe FROM q)
SELECT page_id, lower(u.scheme) || '://' || lower(u.host) || CASE WHEN u.path = '' THEN '/' ELSE u.path END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical,
  regexp_replace(lower(u.host), '^www\.', '') AS host, u.host AS loose_host, regexp_extract(url, '(?:https?://)?(?:www\.)?([^/]+)', 1) AS domain,
  u.scheme || '://' || u.host || u.path || CASE WHEN safe <> '' THEN '?' || safe ELSE '' END || u.frag AS sanitized FROM k"""

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
_EVENT = "CASE WHEN hay = '' THEN 'UNKNOWN' " + " ".join("WHEN " + " OR ".join(f"contains(hay, '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in EVENT_TYPES) + " ELSE 'UNKNOWN' END"
_FLAT = lambda name: re.sub("[^a-z0-9]+", " ", name.lower()).strip()
_HITS = ", ".join("CASE WHEN " + " OR ".join(f"contains(flat, ' {a} ')" for a in dict.fromkeys(map(_FLAT, (*names, value)))) + f" THEN '{value}' END" for _, value, names in sorted(ENTITIES, key=lambda e: e[1]))
_SAID = rf"""
t AS (SELECT *, trim(regexp_replace(lower(regexp_replace(trim(title), '(?i)^(breaking|announcement|news|update|update\s*\d*|hot|exclusive|\[\s*[a-z\s_-]+\s*\]|\(\s*[a-z\s_-]+\s*\))\s*[:\-]\s*', '')), '[^a-z0-9]+', ' ', 'g')) AS normalized_title FROM items),
h AS (SELECT *, lower(CASE WHEN normalized_title <> '' THEN ' ' || normalized_title ELSE '' END || CASE WHEN trim(summary) <> '' THEN ' ' || trim(summary) ELSE '' END) AS hay, ' ' || trim(regexp_replace(lower(title || ' ' || summary), '[^a-z0-9]+', ' ', 'g')) || ' ' AS flat FROM t)"""
ORACLES["text_features"] = rf"""{_W}, {_SAID}
SELECT hot_item_id, normalized_title, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title || ' ' || summary), '[^a-z0-9]+'), lambda w: len(w) >= 3 AND w NOT IN ({_STOP})))), ' ') AS keywords,
  {_EVENT} AS event_type, array_to_string(list_filter([{_HITS}], lambda x: x IS NOT NULL), ',') AS entities, sha256(trim(regexp_replace(title, '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS title_hash FROM h"""

ORACLES["external_id_extraction"] = rf"""{_W}
SELECT hot_item_id, coalesce(nullif(regexp_extract(source_url, '^https://arxiv\.org/abs/(.*)$', 1), ''), nullif(regexp_extract(title || ' ' || summary, '(?i)\b(?:arxiv[:\s]+)?(\d{{4}}\.\d{{4,5}})\b', 1), '')) AS arxiv, nullif(regexp_extract(source_url, '^https://github\.com/(.*)$', 1), '') AS github,
  nullif(regexp_extract(source_url, '^https://huggingface\.co/(.*)$', 1), '') AS hf_model, nullif(regexp_extract(source_url, '^https://news\.ycombinator\.com/item\?id=(.*)$', 1), '') AS hn_item,
  nullif(regexp_extract(source_url, '^https://twitter\.com/[^/]*/status/(.*)$', 1), '') AS tweet, external_id AS external FROM items"""

_L = "ln(1 + least({cap}.0, greatest(0, {v}))) / ln(1.0 + {cap}) * 100"
_log = lambda v, cap: _L.format(v=v, cap=cap)
#: Which records normalizers take: the news source has three keywords.
_GATE = "(said <> '' OR source_type IN ('GITHUB', 'HUGGING_FACE')) AND (source_type <> 'HACKER_NEWS' OR contains(lower(said || ' ' || said), 'gpt') OR contains(lower(said || ' ' || said), 'the') OR contains(lower(said || ' ' || said), 'de'))"
ORACLES["normalized_items"] = rf"""{_W},
n AS (SELECT *, trim(regexp_replace(title, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS said, comments_count % 20 + 1 AS rank, points AS p, comments_count AS c FROM items)
SELECT hot_item_id AS id, source_type, CASE source_type WHEN 'ARXIV' THEN 'PAPER' WHEN 'GITHUB' THEN 'REPOSITORY' WHEN 'HUGGING_FACE' THEN 'MODEL' WHEN 'HACKER_NEWS' THEN 'POST' WHEN 'HACKER_NEWS_SEARCH' THEN 'ARTICLE' WHEN 'WEIBO_HOT_SEARCH' THEN 'TREND' WHEN 'TWITTER' THEN 'POST' WHEN 'SOGOU_SEARCH' THEN 'SEARCH_RESULT' ELSE 'WEB_PAGE' END AS item_type,
  CASE source_type WHEN 'GITHUB' THEN 'o/r' || external_id WHEN 'HUGGING_FACE' THEN 'o/m' || external_id WHEN 'TWITTER' THEN substring(said, 1, 100) ELSE said END AS title,
  CAST(CASE source_type WHEN 'ARXIV' THEN 0 WHEN 'TWITTER' THEN p + 3 * c + p * 10 // 100 WHEN 'BING_SEARCH' THEN 21 - rank WHEN 'DUCKDUCKGO_SEARCH' THEN 21 - rank WHEN 'SOGOU_SEARCH' THEN 21 - rank ELSE p END AS BIGINT) AS points,
  CAST(CASE WHEN source_type IN ('GITHUB', 'HUGGING_FACE', 'HACKER_NEWS', 'HACKER_NEWS_SEARCH') THEN c WHEN source_type = 'TWITTER' THEN c + 1 ELSE 0 END AS BIGINT) AS comments_count,
  round(CASE source_type WHEN 'GITHUB' THEN {_log("p + p", 5000)} WHEN 'HUGGING_FACE' THEN {_log("c", 500)} WHEN 'HACKER_NEWS' THEN {_log("p", 500)} WHEN 'HACKER_NEWS_SEARCH' THEN {_log("p", 500)} WHEN 'TWITTER' THEN {_log("p * 10 + p", 100000)} WHEN 'WEIBO_HOT_SEARCH' THEN {_log("p", 1000000)} ELSE 0.0 END, 6) AS attention,
  round(CASE source_type WHEN 'GITHUB' THEN {_log("c", 500)} WHEN 'HACKER_NEWS' THEN {_log("c", 200)} WHEN 'HACKER_NEWS_SEARCH' THEN {_log("c", 200)} WHEN 'TWITTER' THEN {_log("c + 1", 10000)} WHEN 'WEIBO_HOT_SEARCH' THEN greatest(0.0, 100.0 - 2 * (rank - 1)) ELSE 0.0 END, 6) AS discussion,
  round(CASE source_type WHEN 'ARXIV' THEN 3 / 20.0 * 100 * 0.6 + 2 / 10.0 * 100 * 0.4 WHEN 'GITHUB' THEN {_log("p + 2 * c + p", 10000)} WHEN 'HUGGING_FACE' THEN {_log("p", 50000)} WHEN 'TWITTER' THEN {_log("p + 3 * c", 25000)} ELSE 0.0 END, 6) AS adoption,
  round(CASE WHEN source_type IN ('BING_SEARCH', 'DUCKDUCKGO_SEARCH', 'SOGOU_SEARCH') THEN greatest(1, rank - least(20, rank) + 1) / rank::DOUBLE * 100.0 ELSE 0.0 END, 6) AS relevance,
  CAST(CASE WHEN source_type IN ('BING_SEARCH', 'DUCKDUCKGO_SEARCH', 'SOGOU_SEARCH') THEN rank END AS INT) AS rank
FROM n WHERE {_GATE}"""
_TAGGED = rf"""
nt AS (SELECT *, trim(regexp_replace(title, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS said, trim(regexp_replace(summary, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS body, CASE hot_item_id % 6 WHEN 0 THEN 'arxiv.org' WHEN 1 THEN 'github.com' WHEN 2 THEN 'huggingface.co' WHEN 3 THEN 'news.ycombinator.com' WHEN 4 THEN 'twitter.com' ELSE 'example.com' END AS host FROM items),
x AS (
  SELECT hot_item_id AS id, source_type, CASE source_type WHEN 'ARXIV' THEN 'cs.AI,' || author WHEN 'GITHUB' THEN 'Tools,' || author || ',Python' WHEN 'HUGGING_FACE' THEN 'nlp,' || author || ',text-generation' WHEN 'HACKER_NEWS_SEARCH' THEN 'hacker-news-search,AI agent OR ai' WHEN 'WEIBO_HOT_SEARCH' THEN 'weibo-hot-search,AI agent OR ai' || CASE WHEN hot_item_id % 2 = 0 THEN ',Tech' ELSE '' END
      WHEN 'TWITTER' THEN 'twitter,AI agent OR ai' || coalesce(',' || nullif(array_to_string(list_distinct(regexp_extract_all(said, '#[a-zA-Z0-9_]+')), ','), ''), '') WHEN 'BING_SEARCH' THEN 'bing-search,AI,agent,OR,en-US,' || host WHEN 'DUCKDUCKGO_SEARCH' THEN 'duckduckgo-search,AI,agent,OR,us-en,' || host WHEN 'SOGOU_SEARCH' THEN 'AI,agent,site' || (hot_item_id % 3)
      ELSE array_to_string(list_filter(['GPT', 'THE', 'de'], lambda k: contains(lower(said || ' ' || said), lower(k))), ',') END AS tags,
    CASE WHEN source_type = 'HUGGING_FACE' THEN 'Pipeline: text-generation | Tags: nlp, ' || author || ', text-generation' WHEN source_type = 'WEIBO_HOT_SEARCH' THEN '热度: ' || points WHEN source_type = 'HACKER_NEWS' THEN substring(said, 1, 1000) WHEN source_type = 'TWITTER' THEN said ELSE nullif(substring(body, 1, 2000), '') END AS brief,
    CASE WHEN source_type IN ('ARXIV', 'GITHUB', 'HACKER_NEWS', 'TWITTER') THEN author WHEN source_type = 'HUGGING_FACE' THEN 'o' WHEN source_type = 'HACKER_NEWS_SEARCH' THEN NULL WHEN source_type = 'SOGOU_SEARCH' THEN 'site' || (hot_item_id % 3) WHEN source_type = 'WEIBO_HOT_SEARCH' THEN '微博热搜' ELSE host END AS author, CASE WHEN source_type = 'GITHUB' THEN 'Python' END AS language
  FROM nt WHERE {_GATE})"""
ORACLES["item_texts"] = rf"""{_W}, {_TAGGED}
SELECT id, tags, sha256(brief) AS summary_hash, CAST(len(brief) AS BIGINT) AS summary_chars, author, language FROM x"""


ORACLES["item_upsert"] = """
SELECT event_type AS source_type, user_id AS external_id, arg_max(event_id, (ts, event_id)) AS id, round(arg_max(value, (ts, event_id)), 6) AS value, CAST(floor(epoch_us(min(ts)) / 1000000.0) AS BIGINT) AS first_seen, CAST(floor(epoch_us(max(ts)) / 1000000.0) AS BIGINT) AS last_seen
FROM events GROUP BY event_type, user_id"""

SNAPSHOTS = """
snap AS (
  SELECT event_id AS id, user_id AS hot_item_id, ts AS observed_at, event_type AS t, CASE event_type WHEN 'view' THEN 'BING_SEARCH' WHEN 'click' THEN 'HACKER_NEWS' WHEN 'purchase' THEN 'GITHUB' WHEN 'signup' THEN 'HUGGING_FACE' ELSE 'TWITTER' END AS source_type,
    least(abs(value), 100.0) AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
snapshots AS (
  SELECT id, hot_item_id, observed_at, source_type, CASE WHEN t IN ('click', 'signup', 'error') THEN v ELSE 0.0 END AS attention, CASE WHEN t IN ('click', 'error') THEN v / 2 ELSE 0.0 END AS discussion, CASE WHEN t IN ('purchase', 'signup') THEN v ELSE 0.0 END AS adoption,
    CASE WHEN t = 'view' THEN v ELSE 0.0 END AS relevance, CASE WHEN t = 'view' THEN id % 20 + 1 END AS rank,
    CASE t WHEN 'view' THEN ['rank'] WHEN 'click' THEN ['commentsCount', 'points'] WHEN 'purchase' THEN ['openIssuesCount', 'stargazersCount'] WHEN 'signup' THEN ['downloads'] ELSE ['likeCount'] END AS names,
    CASE t WHEN 'view' THEN [k] WHEN 'click' THEN [k + 1, k] WHEN 'purchase' THEN [k * 2, k] WHEN 'signup' THEN [k] ELSE [k] END AS vals FROM snap),
last AS (SELECT *, row_number() OVER (PARTITION BY hot_item_id ORDER BY observed_at DESC, id DESC) AS turn FROM snapshots)"""
ORACLES["latest_snapshot"] = f"WITH {SNAPSHOTS} SELECT hot_item_id, id, CAST(turn AS BIGINT) AS turn FROM last WHERE turn <= 3"

_DIM = ("attention", "discussion", "adoption", "relevance")
_kinds = " UNION ALL ".join(f"SELECT '{s}' AS source_type, '{m}' AS metric, '{k}' AS kind, {dict(MONO=1.0, VOLATILE=0.6, RANK=0.3, RELEVANCE=0.0)[k]} AS weight" for s, ms in METRICS.items() for m, k in ms.items())
_mom = lambda a, b: f"least(100.0, greatest(0.0, 0.25 * ({' + '.join(f'greatest(0.0, {a}.{d} - {b}.{d})' for d in _DIM)}) + CASE WHEN {b}.rank - {a}.rank > 0 THEN least({b}.rank - {a}.rank, 20) ELSE 0 END))"
TRENDS = f"""{SNAPSHOTS},
w AS (SELECT * FROM (VALUES ('1h', 3600::BIGINT, 900::BIGINT, 300::BIGINT, 600::BIGINT), ('6h', 21600, 3600, 1200, 2400), ('24h', 86400, 10800, 1800, 5400), ('3d', 259200, 43200, 10800, 21600)) AS w(code, target_s, most_s, high_s, medium_s)),
cur AS (SELECT l.*, w.*, l.observed_at - to_seconds(w.target_s) AS target FROM last l CROSS JOIN w WHERE l.turn = 1),
h1 AS (SELECT c.hot_item_id, c.code, s.id AS sid, s.observed_at AS at, row_number() OVER (PARTITION BY c.hot_item_id, c.code ORDER BY abs(epoch_us(s.observed_at) - epoch_us(c.target)), s.observed_at, s.id) AS n
  FROM cur c JOIN snapshots s ON s.hot_item_id = c.hot_item_id AND s.observed_at BETWEEN c.target - to_seconds(c.most_s) AND c.target + to_seconds(c.most_s)),
h AS (SELECT h1.code, s.* FROM h1 JOIN snapshots s ON s.id = h1.sid WHERE n = 1),
p1 AS (SELECT c.hot_item_id, c.code, s.id AS sid, row_number() OVER (PARTITION BY c.hot_item_id, c.code ORDER BY abs(epoch_us(s.observed_at) - epoch_us(h.observed_at - to_seconds(c.target_s))), s.observed_at, s.id) AS n
  FROM cur c JOIN h ON h.hot_item_id = c.hot_item_id AND h.code = c.code JOIN snapshots s ON s.hot_item_id = c.hot_item_id AND s.observed_at BETWEEN h.observed_at - to_seconds(c.target_s) - to_seconds(c.most_s) AND h.observed_at - to_seconds(c.target_s) + to_seconds(c.most_s)),
p AS (SELECT p1.code, s.* FROM p1 JOIN snapshots s ON s.id = p1.sid WHERE n = 1),
kinds AS ({_kinds}),
cu AS (SELECT hot_item_id, code, source_type, unnest(names) AS metric, unnest(vals) AS x FROM cur),
hu AS (SELECT h.hot_item_id, h.code, unnest(h.names) AS metric, unnest(h.vals) AS x FROM h),
rawd AS (
  SELECT k.hot_item_id, k.code AS "window", k.metric, k.kind, k.weight, hu.x AS previous, cu.x AS current, cu.x - hu.x AS delta, CASE WHEN hu.x > 0 AND cu.x IS NOT NULL THEN greatest(-1.0, (cu.x - hu.x) / hu.x) END AS growth, coalesce(k.kind = 'MONO' AND cu.x - hu.x < 0, false) AS anomaly
  FROM (SELECT c.hot_item_id, c.code, kinds.* FROM cur c JOIN h USING (hot_item_id, code) JOIN kinds ON kinds.source_type = c.source_type) k
  LEFT JOIN cu ON cu.hot_item_id = k.hot_item_id AND cu.code = k.code AND cu.metric = k.metric LEFT JOIN hu ON hu.hot_item_id = k.hot_item_id AND hu.code = k.code AND hu.metric = k.metric
  WHERE cu.x IS NOT NULL OR hu.x IS NOT NULL),
ra AS (SELECT hot_item_id, "window", bool_or(anomaly) AS reset, CASE WHEN count(CASE WHEN weight > 0 THEN growth END) > 0 THEN greatest(-1.0, sum(CASE WHEN weight > 0 AND growth IS NOT NULL THEN growth * weight END) / sum(CASE WHEN weight > 0 AND growth IS NOT NULL THEN weight END)) END AS growth_rate FROM rawd GROUP BY 1, 2),
trends AS (
  SELECT c.hot_item_id, c.code AS "window", {", ".join(f"c.{d} - h.{d} AS {d}_delta" for d in _DIM)}, CAST(h.rank - c.rank AS INT) AS rank_delta, CASE WHEN h.id IS NOT NULL THEN {_mom("c", "h")} END AS momentum,
    0.25 * ({" + ".join(f"(c.{d} - h.{d})" for d in _DIM)}) + CASE WHEN h.rank - c.rank IS NOT NULL THEN greatest(-20, least(20, h.rank - c.rank)) ELSE 0 END AS velocity,
    CASE WHEN abs(epoch_us(h.observed_at) - epoch_us(c.target)) <= c.high_s * 1000000 THEN 'HIGH' WHEN abs(epoch_us(h.observed_at) - epoch_us(c.target)) <= c.medium_s * 1000000 THEN 'MEDIUM' ELSE 'LOW' END AS level,
    h.id IS NOT NULL AS known, ra.reset, ra.growth_rate, CASE WHEN p.id IS NOT NULL THEN {_mom("c", "h")} - {_mom("h", "p")} END AS acceleration
  FROM cur c LEFT JOIN h ON h.hot_item_id = c.hot_item_id AND h.code = c.code LEFT JOIN p ON p.hot_item_id = c.hot_item_id AND p.code = c.code LEFT JOIN ra ON ra.hot_item_id = c.hot_item_id AND ra."window" = c.code),
tr AS (SELECT *, CASE WHEN NOT known THEN 'UNKNOWN' WHEN reset THEN 'METRIC_RESET' ELSE level END AS confidence FROM trends)"""
ORACLES["item_trends"] = f"""WITH {TRENDS} SELECT hot_item_id, "window", {", ".join(f"round({d}_delta, 6) AS {d}_delta" for d in _DIM)}, rank_delta, round(momentum, 6) AS momentum, CASE WHEN known THEN round(velocity, 6) END AS velocity, confidence, round(growth_rate, 6) AS growth_rate, round(acceleration, 6) AS acceleration FROM tr"""
ORACLES["growth_24h"] = f"""WITH {TRENDS} SELECT hot_item_id, {", ".join(f"round({d}_delta, 6) AS {d}_delta" for d in _DIM)}, round(momentum, 6) AS momentum,
  CASE WHEN NOT known THEN 'UNKNOWN' WHEN {" OR ".join(f"{d}_delta < 0" for d in _DIM)} THEN 'METRIC_RESET' ELSE level END AS confidence FROM tr WHERE "window" = '24h'"""
CLUSTER = f"""{TRENDS},
em AS (SELECT hot_item_id % 40 AS hot_cluster_id, hot_item_id, {_ROLE} AS role, 'https://x.example/' || (hot_item_id % 3) AS url, rank, attention, discussion, adoption, relevance, observed_at AS published_at FROM last WHERE turn = 1),
one AS (SELECT *, row_number() OVER (PARTITION BY hot_cluster_id, url ORDER BY rank NULLS LAST, hot_item_id) AS n FROM em WHERE role = 'DISCOVERY'),
kept AS (SELECT hot_cluster_id, hot_item_id FROM one WHERE n = 1 UNION ALL SELECT hot_cluster_id, hot_item_id FROM em WHERE role <> 'DISCOVERY'),
ct AS (
  SELECT hot_cluster_id, "window", count(*) AS contributing, least(100.0, greatest(0.0, sum(momentum) / count(*))) AS momentum, CASE WHEN count(growth_rate) > 0 THEN greatest(-1.0, avg(growth_rate)) END AS growth_rate, avg(acceleration) AS acceleration,
    max(CASE confidence WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END) AS level, sum(attention_delta) + sum(discussion_delta) + sum(adoption_delta) + sum(relevance_delta) AS total
  FROM kept JOIN tr USING (hot_item_id) WHERE confidence <> 'UNKNOWN' GROUP BY 1, 2),
cte AS (
  SELECT e.hot_cluster_id, e.code AS "window", ct.contributing, ct.momentum, ct.growth_rate, ct.acceleration, CASE ct.level WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' WHEN 4 THEN 'METRIC_RESET' ELSE 'UNKNOWN' END AS confidence,
    CASE WHEN ct.contributing IS NULL THEN 'NEW' WHEN total > 5 THEN CASE WHEN ct.acceleration < 0 THEN 'PEAKING' ELSE 'RISING' END WHEN total < -5 THEN 'COOLING' ELSE 'STABLE' END AS state
  FROM (SELECT DISTINCT em.hot_cluster_id, w.code FROM em CROSS JOIN w) e LEFT JOIN ct ON ct.hot_cluster_id = e.hot_cluster_id AND ct."window" = e.code)"""
ORACLES["cluster_trends"] = f"""WITH {CLUSTER} SELECT hot_cluster_id, "window", contributing, round(momentum, 6) AS momentum, round(growth_rate, 6) AS growth_rate, round(acceleration, 6) AS acceleration, confidence, state FROM cte"""
ORACLES["cluster_raw_deltas"] = f"""WITH {CLUSTER}
SELECT hot_cluster_id, r."window", metric, round(sum(delta), 6) AS delta, round(avg(growth), 6) AS growth, round(arg_max_null(previous, hot_item_id), 6) AS previous, round(arg_max_null(current, hot_item_id), 6) AS current, bool_or(anomaly) AS anomaly
FROM kept JOIN rawd r USING (hot_item_id) GROUP BY 1, 2, 3"""
ORACLES["score_v2"] = f"""WITH {CLUSTER},
m AS (
  SELECT hot_cluster_id, min(published_at) AS first_seen_at, max(CASE WHEN role = 'ADOPTION' THEN adoption END) AS ad_max, avg(CASE WHEN role = 'ADOPTION' THEN adoption END) AS ad_avg, max(CASE WHEN role = 'COMMUNITY' THEN discussion END) AS di_max, avg(CASE WHEN role = 'COMMUNITY' THEN discussion END) AS di_avg,
    max(CASE WHEN role = 'DISCOVERY' THEN relevance END) AS re_max, avg(CASE WHEN role = 'DISCOVERY' THEN relevance END) AS re_avg, max(CASE role WHEN 'PRIMARY' THEN 85.0 WHEN 'ADOPTION' THEN 60.0 WHEN 'COMMUNITY' THEN 45.0 WHEN 'DISCOVERY' THEN 25.0 END) AS authority,
    count(DISTINCT CASE WHEN role <> 'DISCOVERY' THEN role END) AS roles, count(CASE WHEN role = 'DISCOVERY' THEN 1 END) AS urls, min(CASE WHEN role <> 'DISCOVERY' THEN published_at END) AS event_at FROM em GROUP BY 1),
c AS (
  SELECT m.hot_cluster_id, CASE WHEN d.momentum IS NOT NULL THEN least(100.0, greatest(0.0, d.momentum * CASE d.confidence WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.85 WHEN 'LOW' THEN 0.6 ELSE 0.3 END)) ELSE 10.0 END AS c_momentum,
    CASE WHEN ad_max IS NOT NULL THEN least(100.0, greatest(0.0, ad_max + 0.15 * ad_avg)) ELSE 0.0 END AS c_adoption, 100.0 * greatest(0.0, 1 - floor(greatest(0, epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(coalesce(event_at, first_seen_at))) / 3600000000.0) / 72.0) AS c_freshness,
    CASE WHEN re_max IS NOT NULL THEN least(100.0, greatest(0.0, re_max + 0.10 * re_avg)) ELSE 50.0 END AS c_relevance, CAST(coalesce(authority, 20.0) AS DOUBLE) AS c_authority, CASE WHEN di_max IS NOT NULL THEN least(100.0, greatest(0.0, di_max + 0.15 * di_avg)) ELSE 0.0 END AS c_discussion,
    CAST(least(100.0, 25.0 * (roles + CASE WHEN urls > 0 THEN 1 ELSE 0 END)) AS DOUBLE) AS c_evidencediversity
  FROM m LEFT JOIN cte d ON d.hot_cluster_id = m.hot_cluster_id AND d."window" = '24h')
SELECT hot_cluster_id, round(least(100.0, greatest(0.0, c_adoption * 0.15 + c_authority * 0.10 + c_discussion * 0.10 + c_evidencediversity * 0.10 + c_freshness * 0.15 + c_momentum * 0.25 + c_relevance * 0.15)), 4) AS total_score,
  round(c_momentum, 6) AS c_momentum, round(c_adoption, 6) AS c_adoption, round(c_freshness, 6) AS c_freshness, round(c_relevance, 6) AS c_relevance, c_authority, round(c_discussion, 6) AS c_discussion, c_evidencediversity FROM c"""

HISTORY = """
sc AS (SELECT o_orderkey AS id, o_custkey AS hot_cluster_id, CASE WHEN o_orderkey % 3 = 0 THEN 'cross-source-score-v2' ELSE 'hn-score-v1' END AS scoring_version, o_totalprice AS total_score, o_orderdate AS calculated_at FROM orders),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hot_cluster_id, scoring_version ORDER BY calculated_at DESC, id DESC) AS n FROM sc) WHERE n = 1)"""
ORACLES["latest_scores"] = f"WITH {HISTORY} SELECT hot_cluster_id, scoring_version, id, total_score FROM latest"
ORACLES["resolved_scores"] = f"WITH {HISTORY} SELECT hot_cluster_id, total_score, scoring_version FROM (SELECT *, row_number() OVER (PARTITION BY hot_cluster_id ORDER BY scoring_version = 'cross-source-score-v2' DESC) AS k FROM latest) WHERE k = 1"
ORACLES["top_difference"] = f"""WITH {HISTORY},
a AS (SELECT hot_cluster_id FROM latest WHERE scoring_version = 'hn-score-v1' ORDER BY total_score DESC, hot_cluster_id LIMIT 20), b AS (SELECT hot_cluster_id FROM latest WHERE scoring_version <> 'hn-score-v1' ORDER BY total_score DESC, hot_cluster_id LIMIT 20)
SELECT count(*) AS difference FROM a FULL JOIN b USING (hot_cluster_id) WHERE a.hot_cluster_id IS NULL OR b.hot_cluster_id IS NULL"""

ORACLES["clusters_v1"] = f"""{_W} SELECT hot_item_id, min(hot_item_id) OVER (PARTITION BY source_url) AS hot_cluster_id, CASE WHEN min(hot_item_id) OVER (PARTITION BY source_url) = hot_item_id THEN 'SINGLETON' ELSE 'CANONICAL_URL' END AS match_method FROM items"""
ORACLES["primary_items"] = f"""{_W} SELECT hot_cluster_id, hot_item_id AS primary_item_id FROM (SELECT *, row_number() OVER (PARTITION BY hot_cluster_id ORDER BY CASE {_ROLE} WHEN 'PRIMARY' THEN 5 WHEN 'ADOPTION' THEN 4 WHEN 'COMMUNITY' THEN 2 ELSE 1 END DESC, hot_item_id) AS n FROM members) WHERE n = 1"""

RULES = """rules AS (SELECT * FROM (VALUES (1, ['the', 'license'], CAST([] AS VARCHAR[]), 10.0, 24), (2, ['und'], ['GITHUB', 'ARXIV'], 0.0, 6), (4, ['zzzz'], CAST([] AS VARCHAR[]), 0.0, 24)) AS r(rule_id, keywords, sources, least_score, hours))"""
ALERTS = f"""{_W}, {V1}, {RULES},
said AS (
  SELECT c.hot_cluster_id, lower(coalesce(c.title, '') || chr(10) || coalesce(c.summary, '')) || chr(10) || coalesce(string_agg(lower(concat_ws(chr(10), m.title, m.summary, m.source_url)), chr(10)), '') AS hay, list(DISTINCT m.source_type) AS srcs
  FROM clusters c LEFT JOIN members m USING (hot_cluster_id) WHERE c.status = 'ACTIVE' GROUP BY c.hot_cluster_id, c.title, c.summary),
found AS (
  SELECT r.rule_id, s.hot_cluster_id, list_filter(r.keywords, lambda k: contains(s.hay, k)) AS hits, r.hours FROM said s CROSS JOIN rules r LEFT JOIN scores x ON x.hot_cluster_id = s.hot_cluster_id
  WHERE (len(r.sources) = 0 OR list_has_any(r.sources, s.srcs)) AND coalesce(x.total_score, 0) >= r.least_score)"""
ORACLES["alert_matching"] = f"""{ALERTS}
SELECT CAST(rule_id AS BIGINT) AS rule_id, hot_cluster_id, replace(array_to_string(hits, ','), 'license', 'LICENSE') AS matched, sha256(rule_id || ':' || hot_cluster_id || ':' || CAST(floor(epoch(TIMESTAMP '2024-03-15 00:00:00') / (hours * 3600)) AS BIGINT)) AS suppression_key, true AS created FROM found WHERE len(hits) > 0"""
ORACLES["alert_counters"] = f"""{ALERTS} SELECT count(*) AS matched, count(*) AS created, CAST(0 AS BIGINT) AS suppressed, (SELECT count(*) FROM clusters WHERE status = 'ACTIVE') AS scanned FROM found WHERE len(hits) > 0"""

_PLACED = """
ev AS (SELECT hot_cluster_id, hot_item_id, source_type, row_number() OVER (PARTITION BY hot_cluster_id ORDER BY NOT is_primary, assigned_at, hot_item_id) AS place FROM members),
fs AS (SELECT hot_cluster_id, source_type, min(place) AS place FROM ev GROUP BY 1, 2),
srcs AS (SELECT hot_cluster_id, string_agg(source_type, ',' ORDER BY place) AS sources FROM fs GROUP BY 1),
cnt AS (SELECT hot_cluster_id, count(*) AS item_count FROM ev GROUP BY 1)"""
ORACLES["cluster_evidence"] = f"{_W}, {_PLACED} SELECT hot_cluster_id, hot_item_id, place, source_type FROM ev"
ORACLES["cluster_timeline"] = f"{_W} SELECT hot_cluster_id, hot_item_id, place FROM (SELECT *, row_number() OVER (PARTITION BY hot_cluster_id ORDER BY published_at, hot_item_id) AS place FROM members) WHERE place <= 2"
ORACLES["cluster_page"] = f"""{_W}, {V1}, {_PLACED}
SELECT c.hot_cluster_id, s.total_score, cnt.item_count, srcs.sources FROM (SELECT * FROM clusters WHERE status = 'ACTIVE' AND hot_cluster_id IN (SELECT hot_cluster_id FROM members WHERE source_type = 'GITHUB')) c
LEFT JOIN scores s USING (hot_cluster_id) LEFT JOIN srcs USING (hot_cluster_id) LEFT JOIN cnt USING (hot_cluster_id) ORDER BY coalesce(s.total_score, 0) DESC, c.last_seen_at DESC, c.hot_cluster_id DESC LIMIT 25 OFFSET 25"""
ORACLES["daily_reports"] = f"""{_W}, {V1}, {_PLACED},
r AS (SELECT c.hot_cluster_id, c.title, CAST(c.last_seen_at AS DATE) AS d, row_number() OVER (PARTITION BY CAST(c.last_seen_at AS DATE) ORDER BY coalesce(s.total_score, 0) DESC, c.last_seen_at DESC, c.hot_cluster_id DESC) AS place FROM clusters c LEFT JOIN scores s USING (hot_cluster_id) WHERE status = 'ACTIVE'),
n AS (SELECT d, count(*) AS cluster_count FROM r GROUP BY d),
x AS (SELECT r.d, fs.source_type, min(r.place * 1000 + fs.place) AS o FROM r JOIN fs USING (hot_cluster_id) WHERE r.place <= 10 GROUP BY 1, 2),
cov AS (SELECT d, string_agg(source_type, ', ' ORDER BY o) AS covered FROM x GROUP BY d)
SELECT CAST(r.d AS VARCHAR) AS report_date, any_value(n.cluster_count) AS cluster_count, string_agg(CAST(r.hot_cluster_id AS VARCHAR), ',' ORDER BY r.place) AS top_cluster_ids, 'Daily Report for ' || r.d AS title,
  'Tracked ' || any_value(n.cluster_count) || ' active clusters on ' || r.d || '. Top cluster: ' || arg_min(r.title, r.place) || '. Sources covered: ' || any_value(cov.covered) || '.' AS summary
FROM r JOIN n USING (d) JOIN cov USING (d) WHERE r.place <= 10 GROUP BY r.d"""
ORACLES["page_summary"] = f"""{_W}, {V1} SELECT round(avg(total_score), 2) AS mean_score, max(total_score) AS max_score, count(*) FILTER (epoch(last_seen_at) >= epoch(TIMESTAMP '2024-03-15 00:00:00') - 86400) AS fresh, count(*) AS n FROM clusters JOIN scores USING (hot_cluster_id) WHERE contains(lower(title), 'the') AND total_score >= 5"""
ORACLES["cluster_analysis"] = f"""{_W},
a AS (SELECT hot_cluster_id, count(*) AS n, count(DISTINCT source_type) AS s, arg_max(source_type, (published_at, hot_item_id)) AS latest FROM members GROUP BY 1),
b AS (SELECT hot_cluster_id, hot_item_id // 1024 AS block, sha256(string_agg(CAST(hot_item_id AS VARCHAR), ',' ORDER BY hot_item_id)) AS sha FROM members GROUP BY 1, 2),
i AS (SELECT hot_cluster_id, sha256(string_agg(sha, ',' ORDER BY block)) AS input_hash FROM b GROUP BY 1)
SELECT hot_cluster_id, CASE WHEN s >= 2 AND n >= 2 THEN 'HIGH' WHEN n >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, 'The cluster currently aggregates ' || n || ' evidence item(s).' AS first_signal, 'Latest evidence came from ' || latest || '.' AS last_signal,
  CASE WHEN s > 1 AND n >= 3 THEN 'Cross-source clustering should still be spot-checked against raw evidence.' ELSE concat_ws(' ', CASE WHEN s <= 1 THEN 'This signal still depends on a single source family.' END, CASE WHEN n < 3 THEN 'Evidence density is still light, so the narrative may shift after the next crawl.' END) END AS risks, input_hash FROM a JOIN i USING (hot_cluster_id)"""
ORACLES["due_sources"] = """
WITH l AS (SELECT o_custkey AS source_id, max(o_orderdate) AS last, bool_or(o_orderkey % 50 = 0) AS busy FROM orders GROUP BY 1),
d AS (SELECT c_custkey AS source_id, (c_custkey % 7) * 36000 AS every, CASE WHEN c_custkey % 9 = 0 OR c_custkey % 7 = 0 THEN 'DISABLED' WHEN l.busy THEN 'IN_FLIGHT' WHEN epoch(l.last) + (c_custkey % 7) * 36000 > epoch(TIMESTAMP '1998-08-01 00:00:00') THEN 'NOT_YET_DUE' ELSE 'RUN' END AS decision FROM customer LEFT JOIN l ON l.source_id = c_custkey)
SELECT source_id, decision, CASE WHEN decision = 'RUN' THEN 'scheduled:' || source_id || ':' || CAST(floor(epoch(TIMESTAMP '1998-08-01 00:00:00') / every) AS BIGINT) END AS idempotency_key FROM d"""
ORACLES["scheduled_run"] = f"SELECT count(*) AS candidates, count(*) FILTER (decision = 'RUN') AS triggered, count(*) FILTER (decision <> 'RUN') AS skipped, CAST(0 AS BIGINT) AS failed FROM ({ORACLES['due_sources']}) WHERE decision <> 'DISABLED'"
ORACLES["pair_evaluation"] = f"""{_W},
spot AS (SELECT hot_item_id, hot_cluster_id AS c FROM members),
p AS (SELECT CASE WHEN quality = 1 THEN 'OTHER' ELSE 'MODEL_RELEASE' END AS category, doc_id % 2 = 0 AS must, a.c AS ca, b.c AS cb FROM labels LEFT JOIN spot a ON a.hot_item_id = doc_id LEFT JOIN spot b ON b.hot_item_id = doc_id + 1),
g AS (SELECT category, count(*) FILTER (must AND ca = cb) AS tp, count(*) FILTER (NOT must AND ca = cb) AS fp, count(*) FILTER (NOT must AND ca <> cb) AS tn, count(*) FILTER (must AND ca <> cb) AS fn, count(*) FILTER (ca IS NULL OR cb IS NULL) AS missing FROM p GROUP BY ROLLUP (category)),
r AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS p, tp / nullif(tp + fn, 0)::DOUBLE AS r FROM g)
SELECT category, tp, fp, tn, fn, missing, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS false_merge, round(fn / nullif(tp + fn, 0)::DOUBLE, 6) AS false_split FROM r"""
ORACLES["ranking_evaluation"] = f"""{_W}, {V1},
l AS (SELECT doc_id // 4 AS hot_cluster_id, doc_id % 5 AS window_start, CASE WHEN quality = 1 AND toxic = 0 THEN 3 WHEN quality = 1 THEN 2 WHEN toxic = 0 THEN 1 ELSE 0 END AS gain, doc_id % 13 = 0 AS is_major, doc_id AS pos FROM labels),
j AS (SELECT l.*, s.total_score FROM l LEFT JOIN scores s USING (hot_cluster_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY total_score DESC, pos) AS rank, row_number() OVER (PARTITION BY window_start ORDER BY gain DESC, pos) AS best FROM j WHERE total_score IS NOT NULL),
m AS (SELECT window_start, sum(CASE WHEN rank <= 10 THEN (pow(2, gain) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 10 THEN (pow(2, gain) - 1) / log2(best + 1) ELSE 0 END) AS idcg, count(*) FILTER (rank <= 10 AND gain >= 2) AS rel, count(*) FILTER (rank <= 10 AND gain = 0) AS noise, least(10, count(*)) AS shown, count(*) FILTER (is_major AND rank > 10) AS missed FROM k GROUP BY 1),
x AS (SELECT window_start, count(*) FILTER (total_score IS NULL) AS missing, count(*) FILTER (is_major) AS major, count(*) FILTER (is_major AND total_score IS NULL) AS lost FROM j GROUP BY 1)
SELECT x.window_start, missing, round(dcg / nullif(idcg, 0), 6) AS ndcg, round(rel / nullif(shown, 0)::DOUBLE, 6) AS precision_at_n, round(noise / nullif(shown, 0)::DOUBLE, 6) AS noise_at_n, round((coalesce(missed, 0) + lost) / nullif(major, 0)::DOUBLE, 6) AS major_miss_rate FROM x LEFT JOIN m USING (window_start)"""
ORACLES["evaluation_run"] = f"""{_W}, {V1},
a AS (SELECT 'SCORE_THRESHOLD' AS case_type, CASE WHEN s.total_score IS NULL THEN 'ERROR' WHEN s.total_score >= 8.0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM labels l LEFT JOIN scores s ON s.hot_cluster_id = l.doc_id // 4),
b AS (SELECT 'CLUSTER_MEMBERSHIP' AS case_type, CASE WHEN x.hot_cluster_id IS NULL OR y.hot_cluster_id IS NULL THEN 'ERROR' WHEN x.hot_cluster_id = y.hot_cluster_id THEN 'PASSED' ELSE 'FAILED' END AS status FROM labels l LEFT JOIN members x ON x.hot_item_id = l.doc_id LEFT JOIN members y ON y.hot_item_id = l.doc_id + 1)
SELECT case_type, count(*) FILTER (status = 'PASSED') AS passed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'ERROR') AS errors, count(*) AS total, round(count(*) FILTER (status = 'PASSED') / count(*)::DOUBLE, 4) AS pass_rate FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ROLLUP (case_type)"""
_DOMAIN = "regexp_extract(CASE WHEN hot_item_id % 6 = 5 THEN 'https://example.com/' ELSE source_url END, '(?:https?://)?(?:www\\.)?([^/]+)', 1)"
ORACLES["label_pairs"] = f"""{_W},
spot AS (SELECT i.hot_item_id, i.title, m.hot_cluster_id AS c, regexp_extract(CASE WHEN i.hot_item_id % 6 = 5 THEN 'https://example.com/' ELSE i.source_url END, '(?:https?://)?(?:www\\.)?([^/]+)', 1) AS d FROM items i LEFT JOIN members m USING (hot_item_id)),
u AS (
  SELECT a.hot_item_id AS a, b.hot_item_id AS b, 'SAME_CLUSTER' AS reason FROM spot a JOIN spot b ON a.c = b.c AND b.hot_item_id > a.hot_item_id UNION SELECT a.hot_item_id, b.hot_item_id, 'SAME_DOMAIN_DIFFERENT_CLUSTER' FROM spot a JOIN spot b ON a.d = b.d AND b.hot_item_id > a.hot_item_id AND a.c IS DISTINCT FROM b.c
  UNION SELECT a.hot_item_id, b.hot_item_id, 'TITLE_OVERLAP' FROM spot a JOIN spot b ON b.hot_item_id > a.hot_item_id AND len(a.title) >= 8 AND len(b.title) >= 8 AND (contains(lower(a.title), lower(substring(b.title, 1, 8))) OR contains(lower(b.title), lower(substring(a.title, 1, 8)))))
SELECT reason, count(*) AS pairs, CAST(sum(a + b) AS BIGINT) AS ids FROM u GROUP BY reason"""
ORACLES["cluster_samples"] = f"""{_W},
s AS (SELECT o_custkey AS c, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS v, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS total FROM orders GROUP BY 1, 2)
SELECT i.hot_item_id, m.hot_cluster_id AS cluster_id, a.total AS score_v1, b.total AS score_v2 FROM items i LEFT JOIN members m USING (hot_item_id) LEFT JOIN s a ON a.c = m.hot_cluster_id AND a.v = 1 LEFT JOIN s b ON b.c = m.hot_cluster_id AND b.v = 2"""
ORACLES["pair_lines"] = f"""{ORACLES["label_pairs"].rsplit("SELECT reason, count", 1)[0]}
SELECT reason, u.a AS hot_item_id_a, u.b AS hot_item_id_b, reason || '-' || u.a || '-' || u.b AS pair_key, y.title AS title_b, x.source_url AS url_a FROM u JOIN items x ON x.hot_item_id = u.a JOIN items y ON y.hot_item_id = u.b"""
ORACLES["config_validation"] = """
WITH c AS (SELECT c_custkey AS i, c_custkey % 10 AS s, c_custkey % 40 AS k FROM customer)
SELECT i AS source_code, concat_ws(',', CASE WHEN i % 13 = 0 THEN 'crawlIntervalMinutes' END,
  CASE WHEN s = 3 AND k < 1 THEN 'fetchLimit' END, CASE WHEN s = 0 THEN 'searchQuery' END,
  CASE WHEN s = 1 AND k < 1 THEN 'perPage' END, CASE WHEN s = 1 AND 2 * k < 1 THEN 'page' END, CASE WHEN s = 1 AND i % 2 <> 0 THEN 'sort' END, CASE WHEN s = 1 AND i % 3 = 0 THEN 'query' END,
  CASE WHEN s = 2 AND k < 1 THEN 'limit' END, CASE WHEN s = 2 THEN 'sort' END, CASE WHEN s = 2 THEN 'search' END,
  CASE WHEN s = 9 AND k NOT IN (10, 20, 30, 40, 50) THEN 'cnt' END, CASE WHEN s IN (9, 5) AND i % 3 = 0 THEN 'query' END,
  CASE WHEN s = 4 AND k < 1 THEN 'limit' END, CASE WHEN s = 4 AND i % 3 = 0 THEN 'query' END,
  CASE WHEN s = 6 AND k < 1 THEN 'limit' END, CASE WHEN s = 6 AND (k < 1 OR k > 30) THEN 'topDays' END, CASE WHEN s = 6 AND i % 3 = 0 THEN 'query' END,
  CASE WHEN s IN (7, 8) AND (k < 1 OR k > 20) THEN 'limit' END, CASE WHEN s IN (7, 8) AND (k < 1 OR k > 30) THEN 'freshnessDays' END, CASE WHEN s = 7 AND i % 2 <> 0 THEN 'market' END, CASE WHEN s IN (7, 8) AND i % 3 = 0 THEN 'query' END,
  CASE WHEN s = 3 AND i % 7 = 0 THEN 'keywords' END, CASE WHEN s = 1 AND (2 * k - 1) * k >= 1000 THEN 'reach' END) AS errors FROM c"""
ORACLES["accepted_places"] = "SELECT l_orderkey AS hot_item_id, arg_max(l_suppkey, (l_shipdate, l_linenumber)) AS cluster FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber <> 3 GROUP BY 1"
ORACLES["analysis_latest"] = "SELECT c_custkey AS hot_cluster_id, a.id AS analysis_id FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON o_custkey = c_custkey"
ORACLES["task_list"] = "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 50"
ORACLES["review_list"] = "SELECT o.id, l_suppkey AS hot_item_id FROM (SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200) o LEFT JOIN lineitem ON l_orderkey = o.id AND l_linenumber = 2"
ORACLES["review_queue"] = "SELECT l_orderkey * 10 + l_linenumber AS cluster_match_decision_id, 'OPEN' AS status FROM lineitem WHERE l_returnflag = 'R' AND (l_orderkey * 10 + l_linenumber) % 3 <> 0"
ORACLES["moved_items"] = f"""{_W},
n AS (SELECT hot_cluster_id, count(*) AS k FROM members GROUP BY 1)
SELECT hot_cluster_id, CASE WHEN hot_cluster_id % 5 = 0 AND n.k > 0 THEN 'MERGED' ELSE status END AS status, CASE WHEN hot_cluster_id % 5 = 0 AND n.k > 0 THEN hot_cluster_id + 1 END AS merged_into_cluster_id FROM clusters LEFT JOIN n USING (hot_cluster_id)"""
ORACLES["page_checks"] = "SELECT page_id, " + " OR ".join(f"contains(lower(html), '{w}')" for w in ("captcha", "cf-challenge", "cloudflare", "access denied", "enable javascript")) + " AS blocked, contains(lower(html), 'did not match') AS empty, contains(lower(html), '<noscript') AND contains(lower(html), 'javascript') AS javascript FROM pages"
ORACLES["alternate_titles"] = "SELECT conv_id * 1000 + turn AS rank FROM conversations WHERE contains(lower(text), 'the') OR contains(lower(role), 'the')"
ORACLES["traffic"] = """SELECT o_orderkey, CAST(o_orderkey % 100 AS BIGINT) AS bucket, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS day,
  CASE WHEN o_orderdate IS NULL THEN '-' ELSE CAST(floor((epoch(TIMESTAMP '2010-01-01 00:00:00') - epoch(o_orderdate)) / 86400) AS BIGINT) || 'd ago' END AS age FROM orders"""

_LIST = lambda kind: ", ".join("CASE WHEN " + " OR ".join(f"contains(flat, ' {a} ')" for a in dict.fromkeys(map(_FLAT, (*names, value)))) + f" THEN '{value}' END" for k, value, names in ENTITIES if k == kind)
_J = lambda c: f"CASE WHEN len(list_distinct(list_concat(a.{c}, b.{c}))) = 0 THEN 0.0 ELSE (len(a.{c}) + len(b.{c}) - len(list_distinct(list_concat(a.{c}, b.{c})))) / len(list_distinct(list_concat(a.{c}, b.{c})))::DOUBLE END"
#: Every item against every earlier active one of 72 hours, brute force.
MATCHES = rf"""{_W}, {_SAID},
f AS (
  SELECT hot_item_id AS id, published_at AS t, CASE WHEN hot_item_id % 6 = 5 THEN 'https://example.com/p/' || (hot_item_id % 100) || '?a=1&b=2' ELSE source_url END AS url, hot_item_id % 6 AS kind, {_EVENT} AS etype,
    coalesce(CASE WHEN hot_item_id % 6 = 0 THEN regexp_extract(source_url, '[0-9.]+$') END, nullif(regexp_extract(title || ' ' || summary, '(?i)\b(?:arxiv[:\s]+)?(\d{{4}}\.\d{{4,5}})\b', 1), '')) AS arxiv,
    regexp_extract(CASE WHEN hot_item_id % 6 = 5 THEN 'https://example.com/' ELSE source_url END, '^https://([^/]+)', 1) AS publisher,
    list_filter([{_LIST("PRODUCT")}], lambda x: x IS NOT NULL) AS products, list_filter([{_LIST("ORG")}], lambda x: x IS NOT NULL) AS orgs, list_distinct(list_filter(regexp_split_to_array(normalized_title, ' '), lambda x: x <> '')) AS title_words,
    list_distinct(list_filter(regexp_split_to_array(lower(title || ' ' || summary), '[^a-z0-9]+'), lambda w: len(w) >= 3 AND w NOT IN ({_STOP}))) AS keywords FROM h),
g AS (SELECT *, list_concat(products, orgs) AS entities FROM f),
words AS (SELECT id, unnest(keywords) AS k FROM g),
kw AS (SELECT DISTINCT a.id AS x, b.id AS y FROM words a JOIN words b ON a.k = b.k AND a.id <> b.id),
act AS (SELECT g.*, m.hot_cluster_id AS c FROM g JOIN members m ON m.hot_item_id = g.id),
pr AS (
  SELECT a.id AS x, b.id AS y, b.c, b.t AS bt, abs(epoch_us(a.t) - epoch_us(b.t)) / 3600000000.0 AS hours, a.etype = b.etype AS same_type, a.etype = 'UNKNOWN' OR b.etype = 'UNKNOWN' AS unknown, a.url = b.url AS same_url, a.arxiv = b.arxiv AS same_arxiv,
    list_has_any(a.products, b.products) AND CASE WHEN len(a.orgs) > 0 AND len(b.orgs) > 0 THEN list_has_any(a.orgs, b.orgs) ELSE a.publisher = b.publisher END AS same_event, w.x IS NOT NULL AS worded,
    list_has_any(a.entities, b.entities) AS shared, len(a.entities) > 0 AS named, a.kind = b.kind AND a.kind IN (1, 2) AND a.url = b.url AS same_repo,
    a.kind = b.kind AND a.kind IN (3, 4) AND regexp_extract(a.url, '[0-9]+$') = regexp_extract(b.url, '[0-9]+$') AS same_post
  FROM g a JOIN act b ON (b.t < a.t OR (b.t = a.t AND b.id < a.id)) AND b.t >= a.t - INTERVAL 72 HOUR LEFT JOIN kw w ON w.x = a.id AND w.y = b.id),
sg AS (SELECT *, row_number() OVER (PARTITION BY x, same_type ORDER BY bt DESC, y DESC) AS nth FROM pr),
cand AS (
  SELECT *, CASE WHEN same_url THEN 0 WHEN coalesce(same_arxiv, false) OR same_repo OR same_post THEN 1 WHEN shared THEN 2 WHEN worded THEN 3 WHEN same_type AND NOT unknown AND named AND nth <= 50 THEN 4 END AS p,
    row_number() OVER (PARTITION BY x ORDER BY CASE WHEN same_url THEN 0 WHEN coalesce(same_arxiv, false) OR same_repo OR same_post THEN 1 WHEN shared THEN 2 WHEN worded THEN 3 WHEN same_type AND NOT unknown AND named AND nth <= 50 THEN 4 ELSE 9 END, bt DESC, y DESC) AS place FROM sg),
near AS (SELECT cand.*, {_J("title_words")} AS jt, {_J("entities")} AS je, {_J("keywords")} AS jk FROM cand JOIN g a ON a.id = x JOIN g b ON b.id = y WHERE p IS NOT NULL AND (place <= 50 OR p <= 2)),
judged AS (
  SELECT x, y, c, p, place, jt, je, jk, same_type, unknown, same_url, coalesce(same_arxiv, false) AS same_arxiv, same_repo, hours, CASE WHEN same_url OR coalesce(same_arxiv, false) OR same_repo THEN 'L1' WHEN same_event AND (same_type OR unknown) AND hours <= 48 THEN 'L2' ELSE 'L3' END AS layer,
    CASE WHEN same_url THEN 0.97 WHEN coalesce(same_arxiv, false) OR same_repo THEN 0.98 WHEN same_event AND (same_type OR unknown) AND hours <= 48 THEN 0.85
      ELSE round(round(jt * 0.30 + je * 0.35 + jk * 0.15 + CASE WHEN same_type THEN 1.0 WHEN unknown THEN 0.5 ELSE 0.0 END * 0.15 + CASE WHEN floor(hours * 60) <= 1440 THEN 1.0 WHEN floor(hours * 60) >= 4320 THEN 0.0 ELSE 1 - (floor(hours * 60) - 1440) / 2880.0 END * 0.05, 12), 6) END AS score
  FROM near),
said AS (SELECT *, CASE WHEN score >= 0.82 THEN 'ACCEPTED' WHEN score < 0.60 THEN 'REJECTED' ELSE 'REVIEW_REQUIRED' END AS decision FROM judged),
kept AS (
  SELECT x AS hot_item_id, y AS other_id, list_extract(['CANONICAL_URL', 'EXTERNAL_ID', 'ENTITY', 'KEYWORD', 'TIME'], p + 1) AS signal, p, c AS hot_cluster_id, layer, CAST(score AS DOUBLE) AS score, decision FROM said WHERE place <= 50
  UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, CAST(1.0 AS DOUBLE), 'NO_CANDIDATE' FROM g WHERE id NOT IN (SELECT x FROM said)),
top AS (SELECT *, row_number() OVER (PARTITION BY hot_item_id ORDER BY CASE decision WHEN 'ACCEPTED' THEN 3 WHEN 'REVIEW_REQUIRED' THEN 2 WHEN 'REJECTED' THEN 1 ELSE 0 END DESC, score DESC, p, other_id) AS n FROM kept)"""
ORACLES["match_candidates"] = f"{MATCHES} SELECT hot_item_id, other_id, signal, hot_cluster_id, layer, score, decision FROM kept"
ORACLES["match_layers"] = f"{MATCHES} SELECT signal, layer, decision, count(*) AS n, round(avg(score), 5) AS mean_score FROM kept GROUP BY ALL"
ORACLES["best_candidates"] = f"{MATCHES} SELECT hot_item_id, other_id, score, decision FROM top WHERE n = 1"
ORACLES["online_gate"] = f"""{MATCHES}
SELECT i.hot_item_id, CASE WHEN i.hot_item_id % 100 >= 60 THEN 'TRAFFIC_NOT_SELECTED' WHEN b.decision = 'NO_CANDIDATE' THEN 'NO_BEST_CANDIDATE' WHEN b.decision <> 'ACCEPTED' THEN 'BEST_DECISION_' || b.decision WHEN b.layer = 'L3' THEN 'LAYER_L3_NOT_ALLOWED' WHEN b.hot_cluster_id = i.hot_item_id // 4 THEN 'TARGET_EQUALS_SOURCE' END AS skip_reason
FROM items i JOIN top b ON b.hot_item_id = i.hot_item_id AND b.n = 1"""

ORACLES["title_overlap_pairs"] = f"""{_W}
SELECT a.hot_item_id, count(*) AS n, CAST(sum(b.hot_item_id) AS BIGINT) AS sum_other FROM items a JOIN items b ON a.hot_item_id <> b.hot_item_id AND len(a.title) >= 8 AND len(b.title) >= 8 AND (contains(lower(a.title), lower(substring(b.title, 1, 8))) OR contains(lower(b.title), lower(substring(a.title, 1, 8)))) GROUP BY 1"""
BATCH = rf"""{_W}, {_TAGGED},
n AS (SELECT *, trim(regexp_replace(title, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS said, comments_count % 20 + 1 AS rank, CASE WHEN source_type = 'TWITTER' THEN 'https://twitter.com/i/web/status/' || external_id WHEN source_type = 'WEIBO_HOT_SEARCH' THEN 'weibo ' || trim(regexp_replace(title, '[ \t\n\x0b\f\r]+', ' ', 'g')) WHEN hot_item_id % 6 = 5 THEN 'https://example.com/p/' || (hot_item_id % 100) || '?a=1&b=2' ELSE source_url END AS url FROM items),
m AS (
  SELECT hot_item_id, min(hot_item_id) OVER (PARTITION BY url) AS cl, published_at,
    CASE source_type WHEN 'ARXIV' THEN 0 WHEN 'TWITTER' THEN points + 3 * comments_count + points * 10 // 100 WHEN 'BING_SEARCH' THEN 21 - rank WHEN 'DUCKDUCKGO_SEARCH' THEN 21 - rank WHEN 'SOGOU_SEARCH' THEN 21 - rank ELSE points END AS p,
    CASE WHEN source_type IN ('GITHUB', 'HUGGING_FACE', 'HACKER_NEWS', 'HACKER_NEWS_SEARCH') THEN comments_count WHEN source_type = 'TWITTER' THEN comments_count + 1 ELSE 0 END AS c
  FROM n WHERE {_GATE})"""
ORACLES["ingest_batch"] = f"""{BATCH},
g AS (SELECT cl, max(p) AS p, max(c) AS c, count(*) AS n, max(len(string_split(x.tags, ','))) AS tags FROM m JOIN x ON x.id = m.hot_item_id GROUP BY cl)
SELECT cl AS hot_cluster_id, round(ln(1 + least(500.0, p)) / ln(501.0) * 35 + ln(1 + least(200.0, c)) / ln(201.0) * 20 + 30.0 + least(10.0, 2.0 * tags) + least(5.0, 2.5 * (n - 1)), 4) AS total_score FROM g"""
ORACLES["ingest_counts"] = f"{BATCH} SELECT (SELECT count(*) FROM items) AS fetched, count(*) AS matched, count(*) AS persisted, CAST(0 AS BIGINT) AS failed, (SELECT count(*) FROM items) - count(*) AS filtered, 'SUCCEEDED' AS status FROM m"
ORACLES["score_versions"] = f"""SELECT hot_cluster_id, total_score, 'hn-score-v1' AS scoring_version FROM ({ORACLES["score_v1_all"]}) UNION ALL SELECT hot_cluster_id, total_score, 'cross-source-score-v2' FROM ({ORACLES["score_v2"]})"""
ORACLES["tweet_top"] = """
WITH t AS (SELECT o_orderkey AS tweet_id, o_orderkey % 97 AS l, o_orderkey % 31 AS r, CAST(floor(o_totalprice / 10) AS BIGINT) AS v, o_custkey % 500 AS f, o_orderkey % 4 = 0 AS ok FROM orders)
SELECT tweet_id, l AS like_count FROM t WHERE l >= CASE WHEN ok THEN 10 ELSE 20 END AND r >= CASE WHEN ok THEN 4 ELSE 9 END AND v >= CASE WHEN ok THEN 2500 ELSE 5000 END AND f >= CASE WHEN ok THEN 50 ELSE 101 END ORDER BY l + 3 * r + v // 100 DESC, tweet_id LIMIT 30"""
ORACLES["payload_validation"] = """
SELECT doc_id AS case_code, CASE WHEN doc_id % 11 = 0 THEN 'NOT_JSON,PAIR_KEY,ITEM_A,TITLE_A,ITEM_B,TITLE_B,EXPECTATION,CATEGORY' ELSE concat_ws(',', CASE WHEN doc_id % 4 = 0 THEN 'PAIR_KEY' END, CASE WHEN doc_id = 0 THEN 'ITEM_A' END, CASE WHEN doc_id % 5 <> 1 THEN 'ITEM_B' END, CASE WHEN doc_id % 7 = 0 THEN 'TITLE_B' END, CASE WHEN doc_id % 3 = 2 THEN 'EXPECTATION' END, CASE WHEN doc_id % 2 <> 0 THEN 'CATEGORY' END) END AS errors FROM labels"""
ORACLES["source_roles"] = f"""{_W}, r AS (SELECT CAST(CAST(published_at AS DATE) AS VARCHAR) AS day, {_ROLE} AS role, count(*) AS n FROM items GROUP BY 1, 2) SELECT day, role, n, round(n / sum(n) OVER (PARTITION BY day), 6) AS share FROM r"""
ORACLES["activity_windows"] = f"WITH {SNAPSHOTS} SELECT CAST(floor(epoch(observed_at) / 86400) * 86400 AS BIGINT) AS start, source_type, count(*) AS n, round(avg(attention), 6) AS attention FROM snapshots GROUP BY 1, 2"
_R = MATCHES.replace("WITH ", "WITH RECURSIVE ", 1) + """,
yes AS (SELECT x AS hot_item_id, y AS other_id, score FROM said WHERE decision = 'ACCEPTED')"""
ORACLES["clusters_v2"] = f"""{_R},
p AS (SELECT hot_item_id, arg_max(other_id, (score, -other_id)) AS o FROM yes WHERE other_id < hot_item_id GROUP BY 1),
c AS (SELECT hot_item_id, o FROM p UNION ALL SELECT c.hot_item_id, p.o FROM c JOIN p ON c.o = p.hot_item_id)
SELECT i.hot_item_id, coalesce(min(c.o), i.hot_item_id) AS hot_cluster_id FROM items i LEFT JOIN c USING (hot_item_id) GROUP BY i.hot_item_id"""
#: Clusters of all pairs: later items are candidates too, by whatever time.
ORACLES["clusters_merged"] = f"""{_R.replace("(b.t < a.t OR (b.t = a.t AND b.id < a.id)) AND b.t", "a.id <> b.id AND b.t")},
e AS (SELECT hot_item_id AS a, other_id AS b FROM yes UNION SELECT other_id, hot_item_id FROM yes),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
SELECT i.hot_item_id, least(i.hot_item_id, coalesce(min(c.b), i.hot_item_id)) AS hot_cluster_id FROM items i LEFT JOIN c ON c.a = i.hot_item_id GROUP BY i.hot_item_id"""

ORACLES["item_text_metrics"] = rf"""{_W}, {_TAGGED}
SELECT id, array_to_string(list_sort(list_filter(CASE source_type WHEN 'ARXIV' THEN ['pdfUrl=https://arxiv.org/pdf/' || id]
    WHEN 'HUGGING_FACE' THEN ['libraryName=transformers', 'pipelineTag=text-generation', CASE WHEN id % 4 = 2 THEN 'lastModified=2024-01-02' END, 'private=' || CASE WHEN id % 3 = 0 THEN 'true' ELSE 'false' END]
    WHEN 'BING_SEARCH' THEN ['market=en-US', 'sourceHost=' || host] WHEN 'DUCKDUCKGO_SEARCH' THEN ['region=us-en', 'sourceHost=' || host] WHEN 'SOGOU_SEARCH' THEN ['site=site' || (id % 3)]
    WHEN 'WEIBO_HOT_SEARCH' THEN [CASE WHEN id % 2 = 0 THEN 'category=Tech' END] ELSE [] END, lambda v: v IS NOT NULL)), ';') AS text_metrics,
  CASE WHEN source_type = 'WEIBO_HOT_SEARCH' THEN CAST(points * 2 AS DOUBLE) END AS raw_hot FROM (SELECT x.*, nt.host, nt.points FROM x JOIN nt ON nt.hot_item_id = x.id)"""
_CLEAN = lambda c: rf"trim(regexp_replace(coalesce({c}, ''), '[ \t\n\x0b\f\r]+', ' ', 'g'))"
_ANALYSED = rf"""
said AS (SELECT ev.*, {_CLEAN("i.title")} AS t, {_CLEAN("i.summary")} AS s, i.published_at AS said_at FROM ev JOIN items i USING (hot_item_id)),
texts AS (SELECT hot_cluster_id, arg_min(s, place) FILTER (s <> '') AS first_summary, arg_min(t, place) AS first_title, arg_max(source_type, (said_at, -place)) AS latest, string_agg(CAST(hot_item_id AS VARCHAR), ',' ORDER BY place) FILTER (place <= 3) AS refs, count(DISTINCT source_type) AS k FROM said GROUP BY 1),
an AS (
  SELECT c.hot_cluster_id, {_CLEAN("c.title")} AS headline, coalesce(nullif({_CLEAN("c.summary")}, ''), first_summary, nullif(coalesce(first_title, 'No evidence summary available.'), ''), 'No analysis summary available.') AS brief,
    'This cluster turns scattered signals into an event-level view across ' || CASE WHEN k > 1 THEN 'multiple source types' ELSE 'a focused source channel' END || ' (' || replace(sources, ',', ', ') || '). The latest evidence is still recent.' AS why,
    'The cluster currently aggregates ' || item_count || ' evidence item(s).|Source coverage includes ' || replace(sources, ',', ', ') || '.|The cluster remains active with score ' || regexp_replace(regexp_replace(CAST(CAST(total_score AS DECIMAL(24, 6)) AS VARCHAR), '0+$', ''), '\.$', '') || '.|Latest evidence came from ' || latest || '.' AS signals,
    refs, concat_ws('|', CASE WHEN k <= 1 THEN 'This signal still depends on a single source family.' END, CASE WHEN item_count < 3 THEN 'Evidence density is still light, so the narrative may shift after the next crawl.' END, CASE WHEN k > 1 AND item_count >= 3 THEN 'Cross-source clustering should still be spot-checked against raw evidence.' END) AS risks,
    CASE WHEN k >= 2 AND item_count >= 2 THEN 'HIGH' WHEN item_count >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
  FROM told c JOIN texts USING (hot_cluster_id) JOIN srcs USING (hot_cluster_id) JOIN cnt USING (hot_cluster_id) JOIN scores USING (hot_cluster_id))"""
ORACLES["analysis_results"] = rf"""{_W}, {V1}, {_PLACED}, told AS (SELECT hot_cluster_id, CASE WHEN hot_cluster_id % 6 = 0 THEN ' ' ELSE title END AS title, CASE WHEN hot_cluster_id % 2 = 0 THEN summary END AS summary FROM clusters), {_ANALYSED}
SELECT hot_cluster_id, CASE WHEN headline = '' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, CASE WHEN headline = '' THEN 'ANALYSIS_GENERATION_FAILED' END AS failure_code, CASE WHEN headline = '' THEN 'Structured analysis field headline is required.' END AS failure_message,
  CASE WHEN headline <> '' THEN headline END AS headline, CASE WHEN headline <> '' THEN sha256(brief) END AS brief_hash, CASE WHEN headline <> '' THEN why END AS why, CASE WHEN headline <> '' THEN signals END AS signals, CASE WHEN headline <> '' THEN refs END AS refs, CASE WHEN headline <> '' THEN risks END AS risks, CASE WHEN headline <> '' THEN confidence END AS confidence FROM an"""
ORACLES["cluster_details"] = f"""{_W}, {V1}, {_PLACED}
SELECT c.hot_cluster_id, coalesce(item_count, 0) AS item_count, coalesce(sources, '') AS sources, total_score, x.ids AS item_ids, x.title AS first_title FROM clusters c LEFT JOIN cnt USING (hot_cluster_id) LEFT JOIN srcs USING (hot_cluster_id) LEFT JOIN scores USING (hot_cluster_id)
LEFT JOIN (SELECT hot_cluster_id, string_agg(CAST(hot_item_id AS VARCHAR), ',' ORDER BY place) AS ids, arg_min(i.title, place) AS title FROM ev JOIN items i USING (hot_item_id) GROUP BY 1) x USING (hot_cluster_id)"""
ORACLES["report_contents"] = f"""{_W}, {V1}, {_PLACED}, told AS (SELECT * FROM clusters), {_ANALYSED},
r AS (SELECT c.hot_cluster_id, CAST(c.last_seen_at AS DATE) AS d, s.total_score, row_number() OVER (PARTITION BY CAST(c.last_seen_at AS DATE) ORDER BY coalesce(s.total_score, 0) DESC, c.last_seen_at DESC, c.hot_cluster_id DESC) AS place FROM clusters c LEFT JOIN scores s USING (hot_cluster_id) WHERE status = 'ACTIVE')
SELECT CAST(d AS VARCHAR) AS report_date, CAST(place AS INT) AS place, hot_cluster_id, sources, item_count, total_score, confidence, headline FROM r LEFT JOIN srcs USING (hot_cluster_id) LEFT JOIN cnt USING (hot_cluster_id) LEFT JOIN an USING (hot_cluster_id) WHERE place <= 10"""
ORACLES["match_explanations"] = f"""{MATCHES},
j AS (SELECT t.hot_item_id, t.other_id, t.decision, g.url, g.arxiv, g.kind, d.* FROM top t JOIN judged d ON d.x = t.hot_item_id AND d.y = t.other_id JOIN g ON g.id = t.hot_item_id WHERE n = 1 AND t.other_id IS NOT NULL)
SELECT hot_item_id, other_id, CASE WHEN same_url THEN 'CANONICAL_URL' WHEN same_arxiv THEN 'ARXIV_ID' WHEN layer = 'L1' THEN CASE kind WHEN 1 THEN 'GITHUB_REPO' ELSE 'HF_MODEL_ID' END WHEN layer = 'L2' THEN 'ENTITY_TIME' ELSE 'SIMILARITY' END AS method,
  CASE WHEN same_url THEN 'canonical URL match: ' || url WHEN same_arxiv THEN 'arxiv id match: ' || arxiv WHEN layer = 'L1' THEN CASE kind WHEN 1 THEN 'github' ELSE 'hf_model' END || ' id match: ' || regexp_extract(url, '([^/]+/[^/]+)$', 1) WHEN layer = 'L2' THEN 'shared product + organization + compatible event type + time window'
    ELSE 'L3 similarity ' || CASE decision WHEN 'ACCEPTED' THEN 'above accept threshold' WHEN 'REJECTED' THEN 'below reject threshold' ELSE 'in review zone' END END AS said,
  CASE WHEN layer = 'L3' THEN round(jt, 6) END AS "titleSimilarity", CASE WHEN layer = 'L3' THEN round(je, 6) END AS "entityOverlap", CASE WHEN layer = 'L3' THEN round(jk, 6) END AS "keywordOverlap", CASE WHEN layer = 'L3' THEN CASE WHEN same_type THEN 1.0 WHEN unknown THEN 0.5 ELSE 0.0 END::DOUBLE END AS "actionConsistency",
  CASE WHEN layer = 'L3' THEN round(CASE WHEN floor(hours * 60) <= 1440 THEN 1.0 WHEN floor(hours * 60) >= 4320 THEN 0.0 ELSE 1 - (floor(hours * 60) - 1440) / 2880.0 END::DOUBLE, 6) END AS "timeProximity" FROM j"""
