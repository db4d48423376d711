"""SQL that DuckDB runs on the same tables, for every query of ``assayer.plans.queries``."""

from __future__ import annotations

from assayer.sources.documents import TAXONOMY

LEDGER = """
e AS (SELECT event_id, 'u' || user_id AS provider_id, 'r' || event_id AS response_id, ts AS tm, event_type, value,
             CASE WHEN event_type = 'error' THEN CASE WHEN value >= 100 THEN 3 WHEN value >= 40 THEN 2 ELSE 1 END
                  WHEN event_type = 'view' AND value > 60 THEN 1 END AS severity,
             CASE WHEN event_type = 'error' THEN 'service_error' WHEN event_type = 'view' AND value > 60 THEN 'slow_view' END AS type FROM events),
l AS (SELECT *, CAST(row_number() OVER (PARTITION BY provider_id ORDER BY tm, event_id) AS BIGINT) AS seq, CAST(coalesce(severity, 0) AS BIGINT) AS instant_score FROM e)
"""
WINDOW10 = "CAST(coalesce(sum(instant_score) OVER w, 0) AS BIGINT) AS window_score, count(*) OVER w AS window_size"
W10 = "WINDOW w AS (PARTITION BY provider_id ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fires(criterion: dict) -> str:
    pattern = _quoted(criterion["pattern"])
    if not criterion["unless"]:
        return f"regexp_matches(text, {pattern}, 'i')"
    return f"len(list_filter(regexp_extract_all(text, {pattern}, 0, 'i'), lambda m: NOT regexp_matches(m, {_quoted(criterion['unless'][0])}, 'i'))) > 0"


def _flagged() -> str:
    parts = []
    for f in TAXONOMY["flags"]:
        fired = " OR ".join(_fires(c) for c in f["criteria"])
        ids = ", ".join(f"CASE WHEN {_fires(c)} THEN '{c['id']}' END" for c in f["criteria"])
        parts.append(f"SELECT doc_id, source, '{f['type']}' AS type, {f['severity']} AS severity, {len(parts)} AS pos, 'own-1:' || concat_ws('+', {ids}) AS basis FROM documents WHERE {fired}")
    return " UNION ALL ".join(parts)


FLAGGED = f"f AS ({_flagged()})"
CHAIN = f"""
WITH RECURSIVE {LEDGER},
c AS (SELECT provider_id, seq, response_id, concat_ws(chr(10), response_id, strftime(tm, '%Y-%m-%dT%H:%M:%S.%f'), CASE WHEN event_type = 'error' THEN 'withhold' ELSE 'deliver' END,
             CAST(CAST(coalesce(severity, 0) AS DECIMAL(18, 4)) AS VARCHAR), coalesce(type || ':' || severity || ':ev' || event_id, '')) AS body FROM l),
h AS (SELECT provider_id, seq, repeat('0', 64) AS prev_hash, sha256(concat_ws(chr(10), 'assayer-ledger/v1', provider_id, seq, body, repeat('0', 64))) AS hash FROM c WHERE seq = 1
      UNION ALL SELECT c.provider_id, c.seq, h.hash, sha256(concat_ws(chr(10), 'assayer-ledger/v1', c.provider_id, c.seq, c.body, h.hash)) FROM h JOIN c ON c.provider_id = h.provider_id AND c.seq = h.seq + 1)
"""
BLOCKS = f"""
WITH {LEDGER},
r AS (SELECT provider_id, 'b' || (event_id % 5) AS response_id, CASE WHEN value > 100 THEN 'non_releasable' WHEN value > 40 THEN 'custodial_release' ELSE 'self_release' END AS authority, tm AS raised_at FROM l WHERE event_type = 'error'),
d AS (SELECT provider_id, 'b' || (event_id % 5) AS response_id, max(tm) AS released_at FROM l WHERE event_type = 'purchase' GROUP BY ALL),
m AS (SELECT provider_id, response_id, arg_max(authority, raised_at) AS authority, max(raised_at) AS raised_at FROM r GROUP BY ALL),
b AS (SELECT m.*, CASE WHEN d.released_at >= m.raised_at THEN d.released_at END AS released_at FROM m LEFT JOIN d USING (provider_id, response_id))
"""
STANDING = """
s AS (SELECT s_suppkey AS k, s_name AS register_entry_id, 'N' || (s_nationkey % 3) AS jurisdiction, s_nationkey FROM supplier),
t AS (SELECT register_entry_id, jurisdiction, CASE WHEN k % 7 = 0 THEN 'unknown'
             WHEN k % 50 < 25 AND k % 3 <> 0 THEN 'unknown'
             WHEN k % 3 = 2 AND k % 2 = 0 THEN CASE WHEN jurisdiction IN ('N1', 'N' || s_nationkey) THEN 'excluded' ELSE 'elevated_scrutiny' END
             ELSE ['good', 'elevated_scrutiny', 'excluded'][k % 3 + 1] END AS standing FROM s)
"""
SEALED = """
s AS (SELECT event_id AS n, date_trunc('second', ts) AS received, date_trunc('second', ts) + to_seconds((event_id % 11 - 5) * 900) AS signed, event_id % 97 = 0 AS unreadable FROM events)
"""
RATES = f"""
WITH {LEDGER}, i AS (SELECT *, tm >= TIMESTAMP '2024-01-10' AND tm < TIMESTAMP '2024-01-20' AS inside FROM l),
t AS (SELECT provider_id, type, count(*) AS n FROM i WHERE inside AND type IS NOT NULL GROUP BY ALL),
c AS (SELECT provider_id, string_agg(type || '=' || n, ',' ORDER BY type) AS flag_counts, string_agg('"' || type || '":' || n, ',' ORDER BY type) AS j FROM t GROUP BY ALL),
w AS (SELECT provider_id, count(*) AS ledger_rows, count(*) FILTER (inside) AS evaluated_responses, CAST(coalesce(sum(instant_score) FILTER (inside), 0) AS BIGINT) AS severity_weighted_incidents FROM i GROUP BY ALL)
"""
MEDIAN = f"""
WITH {LEDGER}, r AS (SELECT provider_id, event_type AS model, CAST(floor(value * 10) AS BIGINT) AS ms, row_number() OVER (PARTITION BY provider_id, event_type ORDER BY tm DESC, response_id DESC) AS k FROM l),
g AS (SELECT provider_id, model, count(*) AS samples, list_sort(list(ms)) AS d FROM r WHERE k <= 20 GROUP BY ALL)
SELECT provider_id, model, samples, CAST(CASE WHEN samples < 3 THEN NULL WHEN samples % 2 = 1 THEN d[samples // 2 + 1] ELSE floor((d[samples // 2] + d[samples // 2 + 1]) / 2.0 + 0.5) END AS DOUBLE) AS typical_ms FROM g
"""
FRESH = "CASE WHEN unreadable THEN 'seal_malformed' WHEN epoch(signed) - epoch(received) > 300 OR epoch(received) - epoch(signed) > 3600 THEN 'seal_not_fresh' END"
RETIRED = "(unreadable OR signed >= TIMESTAMP '2024-01-15')"


def _forbidden() -> str:
    hosts = ["localhost", "a.localhost", "10.1.2.3", "172.16.0.9", "172.32.0.9", "192.168.1.1", "169.254.0.1", "8.8.8.8", "fd00::1", "fe80::1", "::1", "2001:db8::1", "example.com", "0.0.0.0", "127.9.9.9", "999.1.1.1"]
    allowed = ("172.32.0.9", "8.8.8.8", "2001:db8::1", "example.com", "999.1.1.1")
    return f"SELECT s_suppkey, {hosts!r}[s_suppkey % 16 + 1] AS host, {hosts!r}[s_suppkey % 16 + 1] NOT IN {allowed!r} AS forbidden FROM supplier"


def _txt() -> str:
    rows = ["(0, true, NULL, 'one', NULL, 'abc')", "(1, false, 'version_not_first', NULL, NULL, NULL)", "(2, false, 'no_entry', NULL, NULL, NULL)", "(3, false, 'repeated_tag', NULL, NULL, NULL)", "(4, false, 'not_https', NULL, NULL, NULL)", "(5, false, 'forbidden_host', NULL, NULL, NULL)", "(6, true, NULL, 'a', 'https://x.example/reg', NULL)", "(7, false, 'bad_tag', NULL, NULL, NULL)", "(8, false, 'empty', NULL, NULL, NULL)", "(9, false, 'bad_url', NULL, NULL, NULL)"]
    return f"SELECT s_suppkey, ok, reason, entry_id, register_url, key_set_digest FROM supplier JOIN (VALUES {', '.join(rows)}) AS v(i, ok, reason, entry_id, register_url, key_set_digest) ON s_suppkey % 10 = i"


VERDICT = f"""
WITH {SEALED},
a AS (SELECT *, ['e0', 'e1', 'e2', 'e9', NULL][n % 5 + 1] AS id, n % 4 <> 0 AS sealed, ['k0', 'k1', 'k2', 'k7'][n % 4 + 1] AS sel, n % 37 = 0 AS unbound, n % 3 = 0 AS dns, n % 3 = 0 AND n % 41 <> 0 AS same FROM s),
b AS (SELECT *, coalesce(id IN ('e0', 'e1', 'e2'), false) AS entry, id IS NOT NULL AS named FROM a),
c AS (SELECT *, entry AND sel <> 'k7' AS has_key, CASE WHEN sel = 'k2' THEN 'seal_key_compromised' WHEN sel = 'k1' AND {RETIRED} THEN 'seal_key_retired' END AS status FROM b),
d AS (SELECT *, sealed AND has_key AND status IS NULL AS checked FROM c),
g AS (SELECT *, checked AND n % 7 <> 0 AS signed_ok, checked AND n % 7 <> 0 AND n % 13 <> 0 AS valid, entry AND n % 23 = 0 AS astray FROM d),
f AS (SELECT *, concat_ws(',', CASE WHEN named AND NOT entry THEN 'register_entry_unknown' END, CASE WHEN id = 'e2' THEN 'register_entry_revoked' END, CASE WHEN dns AND NOT same THEN 'key_set_digest_mismatch' END,
    CASE WHEN n % 29 = 0 THEN 'seal_multiple' END, CASE WHEN n % 31 = 0 THEN 'content_after_terminal_seal' END, CASE WHEN unbound THEN 'unknown_content_binding' END, CASE WHEN NOT sealed AND n % 29 <> 0 THEN 'seal_absent' END,
    CASE WHEN sealed AND n % 19 = 0 THEN 'exchange_id_mismatch' END, CASE WHEN sealed THEN {FRESH} END, CASE WHEN sealed AND NOT named THEN 'seal_key_unknown' END, CASE WHEN sealed AND entry AND NOT has_key THEN 'seal_key_unknown' END,
    CASE WHEN sealed AND has_key THEN status END, CASE WHEN checked AND NOT signed_ok THEN 'seal_signature_invalid' END, CASE WHEN signed_ok AND NOT valid THEN 'seal_provider_mismatch' END,
    CASE WHEN valid AND n % 3 = 2 THEN 'seal_model_mismatch' END, CASE WHEN valid AND n % 17 = 0 THEN 'request_modified' END, CASE WHEN astray THEN 'endpoint_not_authorized' END) AS findings FROM g)
SELECT n AS event_id, len(list_filter(string_split(findings, ','), lambda x: x <> '' AND x NOT IN ('unknown_content_binding', 'seal_key_compromised', 'seal_key_retired', 'request_modified') AND NOT (x = 'seal_absent' AND coalesce(id, '') <> 'e1'))) = 0 AS passed,
    sealed AS seal_present, valid AND NOT unbound AS seal_valid, NOT astray AS endpoint_authorized,
    CASE WHEN unbound THEN 'none' WHEN dns AND same THEN CASE WHEN sealed AND has_key AND status IS NOT NULL THEN 'unconfirmed' ELSE 'confirmed' END WHEN dns THEN 'none' WHEN entry THEN 'unconfirmed' ELSE 'none' END AS attribution, findings FROM f
"""


BATCH_ROWS = f"""{RATES} SELECT NULL AS provider_id, '{{"version":"1","trafficClass":"test","windowStart":"2024-01-10","windowEnd":"2024-01-20","evaluatorVersion":"e1","taxonomyVersion":"t1"}}' AS payload
            UNION ALL SELECT provider_id, '{{"providerId":"' || provider_id || '","evaluatedResponses":' || evaluated_responses || ',"flagCounts":{{' || coalesce(j, '') || '}},"severityWeightedIncidents":' || severity_weighted_incidents || ',"incidentRate":null,"suppressed":' || (evaluated_responses < 20) || '}}' FROM w LEFT JOIN c USING (provider_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "flag_scan": f"WITH {FLAGGED} SELECT doc_id, coalesce(string_agg(type, ',' ORDER BY pos), '') AS types, coalesce(string_agg(basis, ',' ORDER BY pos), '') AS basis, CAST(coalesce(sum(severity), 0) AS BIGINT) AS severity FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id",
        "flag_counts_by_type": f"WITH {FLAGGED} SELECT source AS provider_id, type, count(*) AS n, CAST(sum(severity) AS BIGINT) AS severity FROM f GROUP BY ALL",
        "evidence_top3": r"""
            WITH m AS (SELECT doc_id, regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') AS m, regexp_split_to_array(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') AS p FROM documents),
                 x AS (SELECT doc_id, unnest(m) AS t, unnest(range(1, len(m) + 1)) AS i, m, p FROM m WHERE len(m) > 0),
                 y AS (SELECT doc_id, t, i, CAST(list_sum(list_transform(p[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i-1], lambda z: length(z))), 0) AS BIGINT) AS s FROM x WHERE NOT regexp_matches(t, '^127\.')),
                 z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM y)
            SELECT doc_id, CAST(k - 1 AS BIGINT) AS "at", s AS span_start, CAST(s + length(t) AS BIGINT) AS span_end, t AS span_text FROM z WHERE k <= 3""",
        "benchmark_evidence": """
            SELECT doc_id, 'secret' AS type, CAST(3 AS BIGINT) AS severity, 'own-1:model:because' AS basis, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_spans,
                   CAST(CASE WHEN doc_id % 3 <> 0 THEN strpos(text, substr(text, 11, 12)) - 1 END AS BIGINT) AS span_start
            FROM documents JOIN labels USING (doc_id) WHERE toxic = 1""",
        "model_verdict_admissible": "SELECT doc_id, 'secret' AS type, CAST(3 AS BIGINT) AS severity FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'shouting', CAST(1 AS BIGINT) FROM labels WHERE quality = 0",
        "window_score_count": f"WITH {LEDGER} SELECT provider_id, seq, instant_score, {WINDOW10} FROM l {W10}",
        "window_score_time": f"""WITH {LEDGER} SELECT provider_id, seq, instant_score, CAST(sum(instant_score) OVER w - instant_score AS BIGINT) AS window_score, count(*) OVER w - 1 AS window_size FROM l
            WINDOW w AS (PARTITION BY provider_id ORDER BY tm RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 999999 MICROSECONDS FOLLOWING)""",
        "session_scope_score": f"""WITH {LEDGER} SELECT a.provider_id, a.seq, CAST(coalesce(sum(b.instant_score), 0) AS BIGINT) AS window_score, count(b.seq) AS window_size
            FROM l a LEFT JOIN l b ON b.provider_id = a.provider_id AND b.seq BETWEEN a.seq - 10 AND a.seq - 1 AND b.tm >= date_trunc('day', a.tm) GROUP BY a.provider_id, a.seq""",
        "band_by_provider": f"""WITH {FLAGGED}, d AS (SELECT doc_id, documents.source AS provider_id, CAST(coalesce(sum(severity), 0) AS BIGINT) AS instant_score FROM documents LEFT JOIN f USING (doc_id) GROUP BY ALL),
            l AS (SELECT *, CAST(row_number() OVER (PARTITION BY provider_id ORDER BY doc_id) AS BIGINT) AS seq FROM d),
            x AS (SELECT provider_id, seq, doc_id, CAST(instant_score + coalesce(sum(instant_score) OVER w, 0) AS BIGINT) AS score FROM l {W10})
            SELECT *, CASE WHEN score >= 8 THEN 'block' WHEN score >= 4 THEN 'warn' ELSE 'clear' END AS band, greatest(8, score, 1) AS meter FROM x""",
        "rates_suppressed": f"{RATES} SELECT provider_id, evaluated_responses, coalesce(flag_counts, '') AS flag_counts, severity_weighted_incidents, CASE WHEN evaluated_responses >= 20 THEN severity_weighted_incidents / evaluated_responses END AS incident_rate, evaluated_responses < 20 AS suppressed FROM w LEFT JOIN c USING (provider_id)",
        "export_view": f"""{RATES}, p AS (SELECT provider_id, ledger_rows, '{{"providerId":"' || provider_id || '","evaluatedResponses":' || evaluated_responses || ',"flagCounts":{{' || coalesce(j, '') || '}},"severityWeightedIncidents":' || severity_weighted_incidents || ',"incidentRate":null,"suppressed":' || (evaluated_responses < 20) || '}}' AS payload FROM w LEFT JOIN c USING (provider_id))
            SELECT provider_id, payload, CAST(strlen(payload) AS BIGINT) AS would_leave_bytes, ledger_rows FROM p""",
        "ledger_head": f"WITH {LEDGER} SELECT provider_id, seq, response_id, CASE WHEN event_type = 'error' THEN 'withhold' ELSE 'deliver' END AS outcome FROM l QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY seq DESC) = 1",
        "ledger_recent_n": f"WITH {LEDGER} SELECT provider_id, seq, response_id FROM l QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY seq DESC) <= 3",
        "ledger_time_range": f"WITH {LEDGER} SELECT provider_id, seq, response_id, strftime(tm, '%Y-%m-%dT%H:%M:%S.%f') AS at_iso FROM l WHERE tm >= TIMESTAMP '2024-01-15' AND tm < TIMESTAMP '2024-01-16'",
        "ledger_counts": f"WITH {LEDGER} SELECT provider_id, count(*) AS n_rows FROM l GROUP BY ALL",
        "ledger_after_reset": f"WITH {LEDGER}, r AS (SELECT provider_id, max(seq) AS s FROM l WHERE event_type = 'signup' GROUP BY ALL) SELECT l.provider_id, l.seq FROM l LEFT JOIN r USING (provider_id) WHERE s IS NULL OR l.seq > s",
        "chain_append": f"{CHAIN} SELECT provider_id, seq, prev_hash, hash FROM h",
        "chain_verify": f"WITH {LEDGER} SELECT provider_id, count(*) AS rows, CAST(NULL AS BIGINT) AS first_break FROM l GROUP BY ALL",
        "chain_tamper": f"WITH {LEDGER} SELECT provider_id, count(*) AS rows, CAST(CASE WHEN count(*) > 40 THEN 7 END AS BIGINT) AS first_break FROM l GROUP BY ALL",
        "standing_state": f"WITH {STANDING} SELECT register_entry_id, jurisdiction, standing FROM t",
        "seeded_score": f"""WITH {STANDING}, {LEDGER}, x AS (SELECT provider_id, seq, instant_score, {WINDOW10} FROM l {W10})
            SELECT provider_id, seq, coalesce(standing, 'unknown') AS standing, CAST(window_score + instant_score + CASE WHEN standing = 'elevated_scrutiny' THEN 2 ELSE 0 END AS BIGINT) AS score
            FROM x LEFT JOIN t ON provider_id = 'u' || CAST(regexp_extract(register_entry_id, '([0-9]+)$', 1) AS BIGINT)""",
        "severity_floor_join": f"WITH {LEDGER} SELECT response_id, CAST(severity AS BIGINT) AS severity, CAST(CASE WHEN type = 'slow_view' THEN greatest(severity, 2) ELSE severity END AS BIGINT) AS raised FROM l WHERE type IS NOT NULL",
        "worst_authority": f"""WITH {LEDGER} SELECT provider_id, CAST(CAST(tm AS DATE) AS VARCHAR) AS day, CASE WHEN bool_or(coalesce(type = 'service_error', false)) THEN 'custodial_release' ELSE 'self_release' END AS authority,
            CASE WHEN bool_or(coalesce(type = 'service_error', false)) THEN 'non_releasable' ELSE 'self_release' END AS authority_minor FROM l GROUP BY ALL""",
        "effective_thresholds": "SELECT c_custkey, c_custkey % 4 = 0 AS minor, CAST(3 AS BIGINT) AS warn, CAST(CASE WHEN c_custkey % 4 = 0 THEN 6 ELSE 8 END AS BIGINT) AS block, CASE WHEN c_custkey % 4 = 0 THEN 'enforce' ELSE 'annotate' END AS mode FROM customer",
        "pending_provisions": """SELECT n_nationkey, CASE WHEN k % 9 = 8 THEN NULL ELSE concat_ws(',', CASE WHEN k % 5 = 0 THEN 'notice:n' || k END, CASE WHEN k % 2 = 0 THEN 'category:slow_view' END, CASE WHEN k % 3 = 0 THEN 'category:of_' || lower(n_name) END,
            CASE WHEN k % 4 <> 1 AND k % 8 = 0 THEN 'thresholdOverrides' END, CASE WHEN k % 3 <> 1 AND k % 7 = 0 THEN 'modeFloor' END, CASE WHEN k % 11 = 0 THEN 'provenance' END) END AS pending FROM (SELECT *, n_nationkey AS k FROM nation)""",
        "open_blocks": f"{BLOCKS} SELECT provider_id, response_id, authority, epoch_us(raised_at) AS raised_us FROM b WHERE released_at IS NULL",
        "release_decision": f"""{BLOCKS}, q AS (SELECT DISTINCT 'u' || user_id AS provider_id, 'b' || i AS response_id, CASE WHEN user_id % 2 = 0 THEN 'self' ELSE 'custodian' END AS actor, user_id % 3 > 0 AS adult FROM events, range(5) t(i)),
            o AS (SELECT provider_id, response_id, authority FROM b WHERE released_at IS NULL),
            x AS (SELECT q.*, CASE WHEN authority IS NULL THEN 'no_open_block' WHEN authority = 'non_releasable' THEN 'no_override'
                WHEN authority = 'custodial_release' AND actor <> 'custodian' THEN 'custodian_only'
                WHEN authority = 'self_release' AND actor = 'self' AND NOT adult THEN 'adult_only' END AS reason FROM q LEFT JOIN o USING (provider_id, response_id))
            SELECT provider_id, response_id, reason IS NULL AS released, reason FROM x""",
        "monitor_state": f"""{BLOCKS}, top AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY seq DESC) <= 10),
            w AS (SELECT provider_id, CAST(sum(instant_score) AS BIGINT) AS window_score, count(*) AS window_size, count(type) AS window_flags FROM top GROUP BY ALL),
            c AS (SELECT provider_id, string_agg(type || '=' || k, ',' ORDER BY type) AS flag_counts FROM (SELECT provider_id, type, count(*) AS k FROM top WHERE type IS NOT NULL GROUP BY ALL) GROUP BY ALL),
            y AS (SELECT provider_id, typical_ms FROM ({MEDIAN}) WHERE model = 'view'),
            n AS (SELECT provider_id, count(*) AS n_rows FROM l GROUP BY ALL), o AS (SELECT provider_id, count(*) AS k FROM b WHERE released_at IS NULL GROUP BY ALL)
            SELECT provider_id, n_rows, window_score, window_size, window_flags, coalesce(k, 0) AS open_blocks, coalesce(flag_counts, '') AS flag_counts, true AS chain_ok, typical_ms
            FROM n JOIN w USING (provider_id) LEFT JOIN o USING (provider_id) LEFT JOIN c USING (provider_id) LEFT JOIN y USING (provider_id)""",
        "endpoint_authorized": """WITH p AS (SELECT page_id, url, regexp_extract(url, '^(https?)://', 1) AS scheme, lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS host, regexp_replace(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/+$', '') AS path FROM pages)
            SELECT page_id, scheme = 'http' AND CASE WHEN page_id % 2 = 0 THEN path = '/en' OR starts_with(path, '/en/') ELSE path = '/fr' OR starts_with(path, '/fr/') END AS authorized, scheme || '://' || host AS origin, path FROM p""",
        "forbidden_host": _forbidden(),
        "freshness": f"WITH {SEALED} SELECT n AS event_id, {FRESH} AS finding FROM s",
        "key_status_asof": f"WITH {SEALED}, x AS (SELECT *, ['current', 'rotating', 'retired', 'compromised', 'lost'][n % 5 + 1] AS status FROM s) SELECT n AS event_id, status, CASE WHEN status = 'compromised' THEN 'seal_key_compromised' WHEN status = 'retired' AND {RETIRED} THEN 'seal_key_retired' WHEN status = 'lost' THEN 'seal_key_unknown' END AS finding FROM x",
        "verdict_findings": VERDICT,
        "key_set_digest": "WITH k AS (SELECT s_nationkey, string_agg(s_name || chr(10) || to_base64(encode(s_name)) || chr(10), '' ORDER BY s_name) AS m FROM supplier GROUP BY ALL) SELECT s_nationkey, rtrim(translate(to_base64(unhex(sha256(m))), '+/', '-_'), '=') AS digest FROM k",
        "request_digests": "SELECT conv_id, turn, 'sha-256=' || rtrim(translate(to_base64(unhex(sha256(text))), '+/', '-_'), '=') AS digest FROM conversations",
        "txt_bindings": _txt(),
        "transcript_session": "SELECT conv_id AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_no, role, CAST(length(text) AS BIGINT) AS n_chars FROM conversations",
        "residency_counts": "SELECT count(*) AS n_rows, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars FROM conversations",
        "typical_duration_median": MEDIAN,
        "sse_accumulate": "WITH c AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY ALL) SELECT conv_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS sha256, 's' || conv_id AS terminal_seal, true AS content_after_seal, false AS several_seals FROM c",
        "notice_repeat": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_ms(ts) AS t, event_type = 'error' AS w, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS k FROM events),
            r AS (SELECT event_id, user_id, k, t AS last, w, true AS start FROM e WHERE k = 1
                  UNION ALL SELECT e.event_id, e.user_id, e.k, CASE WHEN e.t - r.last >= 2880 * 60000 THEN e.t ELSE r.last END, e.w, e.t - r.last >= 2880 * 60000 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
            SELECT event_id, concat_ws(',', CASE WHEN start THEN 'start' END, CASE WHEN w THEN 'warn' END) AS raised FROM r""",
        "arrival_decay": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_ms(ts) // 60000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) // 60000, event_id) AS k FROM events),
            r AS (SELECT event_id, user_id, k, t, CAST(0.6 AS DOUBLE) AS level FROM e WHERE k = 1
                  UNION ALL SELECT e.event_id, e.user_id, e.k, e.t, least(1.0, CASE WHEN r.level * pow(0.5, (e.t - r.t) / 350.0) < 0.002 THEN 0 ELSE r.level * pow(0.5, (e.t - r.t) / 350.0) END + 0.6) FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
            SELECT event_id, round(level, 6) AS level FROM r""",
        "gate_carryover": f"""WITH RECURSIVE {LEDGER}, s AS (SELECT provider_id, seq, CAST(instant_score + coalesce(sum(instant_score) OVER w, 0) AS BIGINT) AS score, type IS NULL AS clean, value > 250 AS refused FROM l {W10}),
            g AS (SELECT provider_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS score, '' AS outcome, CAST(4 AS BIGINT) AS effective_warn, CAST(8 AS BIGINT) AS effective_block, CAST(0 AS BIGINT) AS clean_remaining FROM s WHERE seq = 1
                  UNION ALL SELECT s.provider_id, s.seq, s.score,
                      CASE WHEN refused THEN 'refuse' WHEN s.score >= CASE WHEN g.clean_remaining > 0 THEN 6 ELSE 8 END THEN 'withhold' WHEN s.score >= CASE WHEN g.clean_remaining > 0 THEN 3 ELSE 4 END THEN 'deliver_with_notice' ELSE 'deliver' END,
                      CAST(CASE WHEN g.clean_remaining > 0 THEN 3 ELSE 4 END AS BIGINT), CAST(CASE WHEN g.clean_remaining > 0 THEN 6 ELSE 8 END AS BIGINT),
                      CAST(CASE WHEN NOT refused AND s.score >= CASE WHEN g.clean_remaining > 0 THEN 6 ELSE 8 END THEN 5 WHEN clean THEN greatest(g.clean_remaining - 1, 0) ELSE g.clean_remaining END AS BIGINT)
                  FROM g JOIN s ON s.provider_id = g.provider_id AND s.seq = g.seq + 1)
            SELECT * FROM g WHERE seq > 0""",
        "refusal_without_send": f"""WITH RECURSIVE {LEDGER}, s AS (SELECT provider_id, seq, CAST(instant_score + coalesce(sum(instant_score) OVER w, 0) AS BIGINT) AS score, type IS NULL AS clean, value > 250 AS refused FROM l {W10}),
            g AS (SELECT provider_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS score, '' AS outcome, CAST(4 AS BIGINT) AS effective_warn, CAST(8 AS BIGINT) AS effective_block, CAST(0 AS BIGINT) AS clean_remaining FROM s WHERE seq = 1
                  UNION ALL SELECT s.provider_id, s.seq, s.score,
                      CASE WHEN refused THEN 'refuse' WHEN s.score >= CASE WHEN g.clean_remaining > 0 THEN 6 ELSE 8 END THEN 'withhold' WHEN s.score >= CASE WHEN g.clean_remaining > 0 THEN 3 ELSE 4 END THEN 'deliver_with_notice' ELSE 'deliver' END,
                      CAST(CASE WHEN g.clean_remaining > 0 THEN 3 ELSE 4 END AS BIGINT), CAST(CASE WHEN g.clean_remaining > 0 THEN 6 ELSE 8 END AS BIGINT),
                      CAST(CASE WHEN NOT refused AND s.score >= CASE WHEN g.clean_remaining > 0 THEN 6 ELSE 8 END THEN 5 WHEN refused THEN g.clean_remaining WHEN clean THEN greatest(g.clean_remaining - 1, 0) ELSE g.clean_remaining END AS BIGINT)
                  FROM g JOIN s ON s.provider_id = g.provider_id AND s.seq = g.seq + 1)
            SELECT provider_id, seq, outcome, clean_remaining FROM g WHERE seq > 0""",
        "gate_reasons": f"""WITH {LEDGER}, s AS (SELECT event_id, CAST(instant_score + coalesce(sum(instant_score) OVER w, 0) AS BIGINT) AS score, event_type = 'error' AND value > 200 AS mandatory, ['enforce', 'annotate', 'observe'][event_id % 3 + 1] AS mode FROM l {W10}),
            o AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'standing_excluded' WHEN event_id % 13 = 0 THEN 'deterministic_refusal' END AS early, CASE WHEN event_id % 4 = 0 THEN 'unsealed_notice' END AS noticed,
                  CASE WHEN mandatory THEN 'mandatory:service_error' WHEN mode = 'observe' THEN 'observe_mode' WHEN score >= 8 THEN CASE mode WHEN 'annotate' THEN 'block_line_annotated' ELSE 'block_line' END WHEN score >= 4 THEN 'warn_line' ELSE 'below_lines' END AS why FROM s)
            SELECT event_id, CASE WHEN early IS NOT NULL OR mandatory THEN 'refuse' WHEN why = 'block_line' THEN 'withhold' WHEN why IN ('warn_line', 'block_line_annotated') THEN 'deliver_with_notice' ELSE 'deliver' END AS outcome,
                   coalesce(early, concat_ws(',', noticed, why)) AS reasons, CASE WHEN early IS NULL THEN concat_ws(',', noticed, CASE WHEN why = 'warn_line' THEN 'warn_band' END) ELSE '' END AS notices FROM o""",
        "gate_result": f"""WITH RECURSIVE {LEDGER}, s AS (SELECT provider_id, seq, event_id, epoch_ms(tm) AS t, CAST(instant_score + coalesce(sum(instant_score) OVER w, 0) AS BIGINT) AS score, type IS NULL AS clean, value > 250 AS excluded, event_id % 13 = 0 AS failed, event_id % 4 = 0 AS unsealed FROM l {W10}),
            g AS (SELECT provider_id, CAST(0 AS BIGINT) AS seq, '' AS outcome, '' AS why, CAST(0 AS BIGINT) AS clean_remaining, CAST(NULL AS BIGINT) AS last, false AS start FROM s WHERE seq = 1
                  UNION ALL SELECT s.provider_id, s.seq,
                      CASE WHEN excluded OR failed THEN 'refuse' WHEN s.score >= CASE WHEN g.clean_remaining > 0 THEN 6 ELSE 8 END THEN 'withhold' WHEN s.score >= CASE WHEN g.clean_remaining > 0 THEN 3 ELSE 4 END THEN 'deliver_with_notice' ELSE 'deliver' END,
                      CASE WHEN excluded THEN 'standing_excluded' WHEN failed THEN 'deterministic_refusal' WHEN s.score >= CASE WHEN g.clean_remaining > 0 THEN 6 ELSE 8 END THEN 'block_line' WHEN s.score >= CASE WHEN g.clean_remaining > 0 THEN 3 ELSE 4 END THEN 'warn_line' ELSE 'below_lines' END,
                      CAST(CASE WHEN excluded THEN g.clean_remaining WHEN NOT failed AND s.score >= CASE WHEN g.clean_remaining > 0 THEN 6 ELSE 8 END THEN 5 WHEN clean THEN greatest(g.clean_remaining - 1, 0) ELSE g.clean_remaining END AS BIGINT),
                      CASE WHEN g.last IS NULL OR s.t - g.last >= 2880 * 60000 THEN s.t ELSE g.last END, g.last IS NULL OR s.t - g.last >= 2880 * 60000
                  FROM g JOIN s ON s.provider_id = g.provider_id AND s.seq = g.seq + 1)
            SELECT provider_id, seq, outcome, clean_remaining, concat_ws(',', CASE WHEN unsealed AND outcome <> 'refuse' THEN 'unsealed_notice' END, why) AS reasons,
                   concat_ws(',', CASE WHEN start THEN 'start' END, CASE WHEN outcome = 'deliver_with_notice' THEN 'warn' END, 'local', CASE WHEN unsealed AND outcome <> 'refuse' THEN 'unsealed_notice' END, CASE WHEN why = 'warn_line' THEN 'warn_band' END) AS notices
            FROM g JOIN s USING (provider_id, seq) WHERE seq > 0""",
        "mandatory_refusal": f"WITH {FLAGGED} SELECT doc_id, arg_min(type, pos) FILTER (type IN ('network_address', 'secret', 'shouting')) AS mandatory FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id",
        "dns_entry": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 THEN 'dns-' || s_name ELSE 'own-' || s_nationkey END AS register_entry_id, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 4 = 0 THEN 'abc' END AS dns_digest FROM supplier",
        "export_residency": f"""{RATES}, p AS (SELECT provider_id, ledger_rows, '{{"providerId":"' || provider_id || '","evaluatedResponses":' || evaluated_responses || ',"flagCounts":{{' || coalesce(j, '') || '}},"severityWeightedIncidents":' || severity_weighted_incidents || ',"incidentRate":null,"suppressed":' || (evaluated_responses < 20) || '}}' AS payload FROM w LEFT JOIN c USING (provider_id))
            SELECT count(*) AS providers, CAST(sum(strlen(payload)) AS BIGINT) AS would_leave_bytes, CAST(sum(ledger_rows) AS BIGINT) AS ledger_rows, (SELECT count(*) FROM conversations) AS transcript_turns, (SELECT count(type) FROM l) AS evidence_spans, true AS sealed, 'https://evaluator.example' AS outbound FROM p""",
        "trail_reducer": """WITH d AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_max(event_id % 9, event_id) AS stage, max(value) AS most FROM events GROUP BY ALL),
            a AS (SELECT *, [0, 1, 1, 1, 2, 3, 4, 4, 5][stage + 1] AS now FROM d),
            m AS (SELECT *, list_transform(range(6), lambda i: CASE WHEN i = 2 AND user_id % 3 = 0 THEN 'skipped' WHEN i < now THEN 'done' WHEN i = now THEN 'active' ELSE 'pending' END) AS m FROM a),
            h AS (SELECT *, CASE WHEN most > 80 THEN CASE WHEN most > 150 AND user_id % 2 <> 0 THEN 0 ELSE 4 END END AS halt FROM m)
            SELECT user_id, day, array_to_string(m, ',') AS marks, array_to_string(list_transform(range(6), lambda i: CASE WHEN halt IS NULL THEN 'done' WHEN i = halt THEN 'stopped' WHEN i > halt THEN 'pending' WHEN (i = 3 AND NOT most < 120) OR m[i + 1] = 'skipped' THEN 'skipped' ELSE 'done' END), ',') AS settled FROM h""",
        "scripted_responses": "SELECT event_id, ['one', 'two', 'three'][least(row_number() OVER (PARTITION BY user_id ORDER BY event_id), user_id % 3 + 1)] AS text FROM events",
        "settings_latest": "SELECT 'u' || user_id AS key, props AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "setting_lookup": "SELECT 'u1' AS key, props AS value FROM events WHERE user_id = 1 ORDER BY ts DESC, event_id DESC LIMIT 1",
        "setting_keys": "SELECT DISTINCT 'u' || user_id AS key FROM events",
        "ledger_providers": "SELECT DISTINCT 'u' || user_id AS provider_id FROM events",
        "evidence_join": f"WITH {LEDGER} SELECT provider_id, seq, type, 'ev' || l.event_id AS ref, props AS spans FROM l JOIN events ON l.event_id = events.event_id WHERE type IS NOT NULL",
        "residency": "SELECT 'transcripts' AS kind, count(*) AS n_rows, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars FROM conversations UNION ALL SELECT 'evidence', count(*), CAST(coalesce(sum(length(to_json({'props': props}))), 0) AS BIGINT) FROM events",
        "keys_gone": "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0",
        "sealed_roundtrip": "SELECT conv_id, turn, sha256(text) AS opened_sha256, true AS refused FROM conversations",
        "strict_json": "SELECT event_id, ['ok', 'duplicate', 'malformed'][event_id % 3 + 1] AS code FROM events",
        "pinned_notices": "SELECT event_type || '-' || user_id % 7 AS id, arg_min(event_id, (ts, event_id)) AS first_event FROM events GROUP BY ALL",
        "self_audit": "WITH p AS (SELECT page_id, regexp_extract(url, '^(https?)://', 1) || '://' || lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS origin FROM pages) SELECT page_id, origin AS evaluator FROM p WHERE origin = (SELECT min(origin) FROM p)",
        "released_content": f"WITH {LEDGER} SELECT provider_id, 'r' || l.event_id AS response_id, props AS content FROM l JOIN events ON l.event_id = events.event_id WHERE l.event_type = 'error' AND l.value > 100",
        "telemetry_batch": BATCH_ROWS,
        "telemetry_signed": f"""SELECT provider_id, CASE WHEN third THEN replace(payload, '"evaluatedResponses":', '"evaluatedResponses":1') ELSE payload END AS payload, NOT coalesce(third, false) AS valid
            FROM (SELECT *, CAST(substr(provider_id, 2) AS BIGINT) % 3 = 0 AS third FROM ({BATCH_ROWS}))""",
        "signed_documents": """SELECT s_suppkey, sha256('{"registerEntryId":"' || s_name || '","nation":' || s_nationkey || '}' || CASE WHEN s_suppkey % 5 = 0 THEN ' ' ELSE '' END) AS document_sha256,
            s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0 AS signature_valid FROM supplier""",
        "dashboard_totals": f"SELECT 'withheld' AS name, count(*) AS n FROM ({BLOCKS} SELECT 1 FROM b WHERE released_at IS NULL) UNION ALL SELECT 'largest_count', coalesce(max(n), 0) FROM ({RATES} SELECT n FROM t)",
        "transport_choice": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'content-block-delta' WHEN s_suppkey % 3 = 0 THEN 'chat-delta' END AS transport FROM supplier",
        "setting_precedence": "SELECT c_custkey, 'off' AS locked, CASE WHEN c_custkey % 3 = 0 THEN 'on' ELSE 'off' END AS free FROM customer",
        "release_affordance": f"{BLOCKS} SELECT provider_id, response_id, authority = 'self_release' AS own, authority <> 'non_releasable' AS custodian FROM b WHERE released_at IS NULL",
        "delivery_notices": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a' || event_id % 4 || ',c' || event_id % 4 ELSE '' END AS shown FROM events",
        "notice_display": "SELECT event_id, event_id % 4 = 0 OR event_id % 3600 * 1000 < event_id % 50 * 60000 AS displayed FROM events",
        "compose_activity": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_ms(ts) // 60000 AS t, CAST(CASE event_id % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 0.32 ELSE 0.32 * least(4, greatest(1, len(regexp_extract_all(coalesce(props, ''), '\\S+')))) END AS DOUBLE) AS bump,
                row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) // 60000, event_id) AS k FROM events),
            r AS (SELECT event_id, user_id, k, t, least(CAST(1 AS DOUBLE), bump) AS level FROM e WHERE k = 1
                  UNION ALL SELECT e.event_id, e.user_id, e.k, e.t, least(1.0, CASE WHEN r.level * pow(0.5, (e.t - r.t) / 700.0) < 0.002 THEN 0 ELSE r.level * pow(0.5, (e.t - r.t) / 700.0) END + e.bump) FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
            SELECT event_id, round(level, 6) AS level FROM r""",
        "stage_latency": "WITH p AS (SELECT event_id, event_id % 5 + event_id % 700 + CASE WHEN event_id % 6 <> 0 THEN event_id % 40 ELSE 0 END AS parts_ms FROM events) SELECT event_id, parts_ms, event_id % 800 + 5 >= parts_ms AS covered FROM p",
        "trail_marks": """WITH x AS (SELECT event_id, [0, 1, 1, 1, 2, 3, 4, 4, 5][event_id % 9 + 1] AS a, [NULL, 'deliver', 'deliver_with_notice', 'withhold', 'refuse'][event_id % 5 + 1] AS o, event_id % 7 = 0 AS unsent, event_id % 3 = 0 AS unread FROM events),
            h AS (SELECT *, CASE WHEN o = 'refuse' AND unsent THEN 0 WHEN o IN ('withhold', 'refuse') THEN 4 END AS s, unnest(range(6)) AS i FROM x),
            m AS (SELECT event_id, string_agg(CASE WHEN starts_with(o, 'deliver') THEN 'done' WHEN s IS NULL THEN CASE WHEN i < a THEN 'done' WHEN i = a THEN 'active' ELSE 'pending' END
                WHEN i = s THEN 'stopped' WHEN i > s THEN 'pending' WHEN i = 3 AND unread THEN 'skipped' ELSE 'done' END, ',' ORDER BY i) AS marks FROM h GROUP BY ALL)
            SELECT event_id, marks, contains(marks, 'stopped') AS halted, marks = 'done,done,done,done,done,done' AS complete FROM m""",
        "outbound_paths": "SELECT page_id, CASE WHEN page_id % 3 = 2 THEN regexp_extract(url, '^(https?)://', 1) || '://' || lower(regexp_extract(url, '^https?://([^/]+)', 1)) ELSE '' END AS paths, regexp_extract(url, '[^/]*$') AS base_name FROM pages",
        "seal_header": "SELECT s_suppkey, s_name AS entry, 'm>?' || s_suppkey AS model, s_suppkey % 2 = 0 AS several FROM supplier",
        "seal_payload": "SELECT conv_id, turn, sha256(concat_ws(chr(10), 'demo-seal', role, conv_id, strlen(text)) || chr(10) || chr(10) || text) AS payload_sha256, sha256(concat_ws(chr(10), 'demo-pre-seal', role, turn)) AS pre_sha256, NOT regexp_matches(coalesce(text, ''), '[\\r\\n]') AS one_line FROM conversations",
        "evaluator_prompt": f"SELECT doc_id, sha256(concat_ws(chr(10), 'Types:', {', '.join(_quoted('- ' + f['type'] + ' (severity ' + str(f['severity']) + ')') for f in TAXONOMY['flags'])}, 'Text:', text)) AS prompt_sha256 FROM documents",
        "stream_roundtrip": "SELECT conv_id || '-' || turn AS exchange_id, sha256(text) AS text_sha256, true AS unsealed FROM conversations",
        "token_counts": "SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '\\s+|\\S+')) AS BIGINT) AS n_tokens, true AS whole FROM conversations",
    }
