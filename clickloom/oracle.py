"""The same results in plain SQL, for checking."""

from __future__ import annotations

from clickloom.fixtures import with_views

# Views of the checks, next to the fixture views.
CHECK_VIEWS = {
    "first_links": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shorturl ORDER BY id) AS rn FROM shorturls) WHERE rn = 1",
    "words": "SELECT lower(trim(value)) AS word FROM filter_lines WHERE trim(value) <> ''",
    "judged_adds": """
SELECT r.*, u.id AS owner_id, COALESCE(r.customshorturlcode,'') <> '' AS custom,
 CASE WHEN COALESCE(r.customshorturlcode,'') <> '' THEN r.customshorturlcode ELSE CAST(u.id AS VARCHAR)||substr(md5(CAST(r.request_id AS VARCHAR)||'salt'),1,4) END AS code,
 CASE WHEN COALESCE(r.token,'') = '' THEN 400 WHEN COALESCE(r.redirecturl,'') = '' THEN 402 WHEN u.id IS NULL THEN 401
  WHEN COALESCE(r.customshorturlcode,'') <> '' AND EXISTS (SELECT 1 FROM words w WHERE contains(lower(r.customshorturlcode), w.word)) THEN 403
  WHEN COALESCE(r.customshorturlcode,'') <> '' AND NOT regexp_full_match(r.customshorturlcode, '[a-zA-Z0-9]+') THEN 405
  WHEN COALESCE(r.customshorturlcode,'') <> '' AND EXISTS (SELECT 1 FROM shorturls s WHERE s.shorturl = r.customshorturlcode) THEN 404 END AS failed
 FROM add_requests r LEFT JOIN users u ON u.token = r.token""",
    "add_outcomes": """
SELECT *, CASE WHEN failed IS NOT NULL THEN failed WHEN custom AND row_number() OVER (PARTITION BY custom, failed, code ORDER BY request_id) > 1 THEN 404
 WHEN custom AND request_id > min(CASE WHEN failed IS NULL AND NOT custom THEN request_id END) OVER (PARTITION BY code) THEN 404 ELSE 200 END AS status FROM judged_adds""",
    "remove_outcomes": """
SELECT r.request_id, r.shorturl, CASE WHEN COALESCE(r.shorturl,'') = '' OR COALESCE(r.token,'') = '' THEN 400
  WHEN o.shorturl IS NULL OR row_number() OVER (PARTITION BY r.shorturl, o.shorturl IS NULL ORDER BY r.request_id) > 1 THEN 404 ELSE 200 END AS status,
 CASE WHEN COALESCE(r.shorturl,'') = '' THEN 'code missing' WHEN COALESCE(r.token,'') = '' THEN 'token missing'
  WHEN o.shorturl IS NULL OR row_number() OVER (PARTITION BY r.shorturl, o.shorturl IS NULL ORDER BY r.request_id) > 1 THEN 'not found' END AS reason
 FROM remove_requests r LEFT JOIN (SELECT DISTINCT token, shorturl FROM shorturls) o ON o.token = r.token AND o.shorturl = r.shorturl""",
    "unlock_results": """
SELECT a.click_id, a.shorturl, a.password,
 CASE WHEN a.click_id IS NULL OR COALESCE(a.password,'') = '' OR COALESCE(a.shorturl,'') = '' THEN 400 WHEN s.shorturl IS NULL THEN 404
  WHEN s.password IS NULL OR s.password <> a.password THEN 401 WHEN c.id IS NULL THEN 404 ELSE 200 END AS status,
 CASE WHEN COALESCE(a.password,'') <> '' AND s.password = a.password AND c.id IS NOT NULL THEN CASE WHEN regexp_matches(s.redirecturl, '(?i)^https?://') THEN s.redirecturl ELSE 'https://'||s.redirecturl END END AS location,
 CASE WHEN COALESCE(a.password,'') <> '' AND s.password = a.password THEN CAST(c.id IS NOT NULL AS BIGINT) END AS matched
 FROM unlock_attempts a LEFT JOIN first_links s ON s.shorturl = a.shorturl LEFT JOIN clicks c ON c.id = a.click_id""",
    "signup_results": """
SELECT r.*, r.firstname = '' OR r.lastname = '' OR r.username = '' OR r.password = '' AS missing, u.id IS NOT NULL AS taken,
 row_number() OVER (PARTITION BY r.username, r.firstname = '' OR r.lastname = '' OR r.username = '' OR r.password = '' ORDER BY r.request_id) AS place
 FROM signup_requests r LEFT JOIN users u ON u.username = r.username""",
    "chat_checked": """
SELECT conn_id, open_ts, close_ts, CASE WHEN error IS NULL THEN trim(name) END AS username, error FROM (
 SELECT *, CASE WHEN first_frame IS NULL THEN NULL WHEN doc IS NULL OR json_type(doc) = 'NULL' THEN 'Invalid username format.' WHEN COALESCE(name,'') = '' THEN 'First message must include a username.' WHEN trim(name) = '' THEN 'Username cannot be empty.' END AS error
 FROM (SELECT *, CASE WHEN json_type(doc, '$.username') = 'VARCHAR' THEN list_last(regexp_extract_all(first_frame, '"username" *: *"([^"]*)"', 1)) END AS name
 FROM (SELECT *, TRY_CAST(first_frame AS JSON) AS doc FROM chat_conns)))""",
    "chat_admissions": """
WITH RECURSIVE o AS (SELECT conn_id, username, open_ts, close_ts, row_number() OVER (PARTITION BY username ORDER BY open_ts, conn_id) AS rn FROM chat_checked WHERE username IS NOT NULL),
f AS (SELECT conn_id, username, rn, TRUE AS admitted, close_ts AS busy FROM o WHERE rn = 1
 UNION ALL SELECT o.conn_id, o.username, o.rn, o.open_ts >= f.busy, CASE WHEN o.open_ts >= f.busy THEN o.close_ts ELSE f.busy END FROM f JOIN o ON o.username = f.username AND o.rn = f.rn + 1)
SELECT c.conn_id, c.open_ts, c.close_ts, c.username, COALESCE(f.admitted, FALSE) AS admitted,
 CASE WHEN c.error IS NULL AND NOT f.admitted THEN 'Username is already taken. Please choose another.' ELSE c.error END AS error
 FROM chat_checked c LEFT JOIN f ON f.conn_id = c.conn_id""",
    "chat_holders": "SELECT conn_id, username, open_ts, close_ts FROM chat_admissions WHERE admitted",
    "chat_recipients": "SELECT conn_id, open_ts, close_ts FROM chat_admissions WHERE error IS NULL",
    "chat_changes": """
SELECT conn_id, 'join' AS kind, open_ts AS ts FROM chat_holders
 UNION ALL SELECT conn_id, 'close' AS kind, CASE WHEN error IS NULL THEN close_ts ELSE open_ts END AS ts FROM chat_admissions""",
    "chat_presence": """
SELECT c.ts, c.conn_id, c.kind, list(h.username ORDER BY h.open_ts, h.conn_id) FILTER (WHERE h.conn_id IS NOT NULL) AS users, CAST(count(h.conn_id) AS INT) AS online
 FROM chat_changes c LEFT JOIN chat_holders h ON h.open_ts <= c.ts AND c.ts < h.close_ts GROUP BY c.ts, c.conn_id, c.kind""",
    "chat_checked_frames": """
SELECT frame_id, conn_id, ts, CASE WHEN doc IS NULL OR json_type(doc) = 'NULL' THEN 'error' WHEN json_type(doc,'$.type') = 'VARCHAR' AND json_extract_string(doc,'$.type') = 'message' AND COALESCE(json_extract_string(doc,'$.message'),'') <> '' THEN 'accepted' ELSE 'ignored' END AS status,
 json_extract_string(doc,'$.message') AS message FROM (SELECT *, TRY_CAST(frame AS JSON) AS doc FROM chat_frames)""",
    "chat_sent": """
SELECT f.frame_id, f.conn_id, f.ts, h.username, f.message FROM chat_checked_frames f JOIN chat_holders h ON h.conn_id = f.conn_id AND h.open_ts <= f.ts AND f.ts < h.close_ts WHERE f.status = 'accepted'""",
    "anchored": """
WITH RECURSIVE o AS (SELECT request_id, ip, ts, row_number() OVER (PARTITION BY ip ORDER BY ts, request_id) AS rn FROM api_requests),
f AS (SELECT request_id, ip, rn, ts AS opened, 1 AS n FROM o WHERE rn = 1
 UNION ALL SELECT o.request_id, o.ip, o.rn, CASE WHEN o.ts >= f.opened + INTERVAL '1' DAY THEN o.ts ELSE f.opened END, CASE WHEN o.ts >= f.opened + INTERVAL '1' DAY THEN 1 ELSE f.n + 1 END FROM f JOIN o ON o.ip = f.ip AND o.rn = f.rn + 1)
SELECT request_id, ip, n > 2 AS limited FROM f""",
    "paged_changes": "SELECT *, CAST(floor((rank() OVER (ORDER BY ts) - 1) / 500) AS BIGINT) AS page FROM chat_changes",
    "page_starts": "SELECT page, min(ts) AS start FROM paged_changes GROUP BY page",
    "recipient_changes": """
SELECT 'open' AS kind, conn_id AS id, open_ts AS ts FROM chat_recipients WHERE open_ts < close_ts
 UNION ALL SELECT 'close' AS kind, conn_id AS id, close_ts AS ts FROM chat_recipients WHERE open_ts < close_ts""",
    "recipient_versions": "SELECT ts, row_number() OVER (ORDER BY ts) AS version FROM (SELECT DISTINCT ts FROM recipient_changes)",
    "clean_clicks": "SELECT * REPLACE (CAST(timestamp AS TIMESTAMP) AS timestamp) FROM clicks",
}

_URL = "CASE WHEN regexp_matches({c}, '(?i)^https?://') THEN {c} ELSE 'https://'||{c} END"
_PATH = "regexp_extract(path, '^[^?#]*')"

CHECKS = {
    "scan_users": "SELECT * FROM users",
    "scan_links": "SELECT * FROM shorturls",
    "scan_clicks": "SELECT * FROM clean_clicks",
    "filter_words": "SELECT upper(p_name) AS word FROM part WHERE p_partkey % 5 <> 0",
    "parse_requests": """
SELECT request_id, CASE WHEN request_id % 9 <> 0 THEN redirecturl END AS redirecturl, CASE WHEN request_id % 9 <> 0 THEN customshorturlcode END AS customshorturlcode,
 CASE WHEN request_id % 9 <> 0 THEN password END AS password, CASE WHEN request_id % 9 = 0 THEN '{oops' END AS malformed FROM add_requests""",
    "parse_access_log": """
SELECT ip, date_trunc('second', ts) AS ts, method, path, status, bytes, CAST(NULL AS VARCHAR) AS referer, 'agent/1.0' AS useragent FROM http_requests WHERE request_id % 17 <> 0 AND request_id % 19 <> 0""",
    "access_log_rejects": """
SELECT 'broken '||CAST(request_id AS VARCHAR) AS value FROM http_requests WHERE request_id % 17 = 0 UNION ALL SELECT '10.0.0.1 - - [99/Foo/2024:00:00:00 +0000] "GET /'||CAST(request_id AS VARCHAR)||' HTTP/1.1" 200 5 "-" "agent/1.0"' AS value FROM http_requests WHERE request_id % 17 <> 0 AND request_id % 19 = 0""",
    "append_links": """
SELECT id, redirecturl, shorturl, token, password FROM shorturls UNION ALL
SELECT (SELECT max(id) FROM shorturls) + row_number() OVER (ORDER BY request_id) AS id, redirecturl, code AS shorturl, token, CASE WHEN password <> '' THEN password END AS password FROM add_outcomes WHERE status = 200""",
    "message_frames": """
SELECT frame_id, '{"type":"message","message":{"username":"'||username||'","message":'||CASE WHEN message LIKE '{%' THEN message ELSE '"'||message||'"' END||'}}' AS json FROM chat_sent""",
    "user_list_frames": """
SELECT ts, conn_id, kind, '{"type":"userList","users":['||COALESCE('"'||array_to_string(users, '","')||'"', '')||']}' AS json FROM chat_presence""",
    "listed_link_json": """
SELECT '{"id":'||CAST(s.id AS VARCHAR)||',"redirecturl":"'||s.redirecturl||'","shorturl":"'||s.shorturl||'","password":'||CASE WHEN s.password IS NOT NULL THEN 'true' ELSE 'false' END||'}' AS json
 FROM shorturls s WHERE s.token IN (SELECT token FROM list_requests)""",
    "add_links": "SELECT request_id, status, CASE WHEN status = 200 THEN code END AS shorturl FROM add_outcomes",
    "added_links": "SELECT request_id, redirecturl, code AS shorturl, token, CASE WHEN password <> '' THEN password END AS password FROM add_outcomes WHERE status = 200",
    "resolve_owner": "SELECT r.request_id, r.token, u.id AS owner_id FROM add_requests r LEFT JOIN users u ON u.token = r.token",
    "code_conflicts": "SELECT request_id, customshorturlcode AS shorturl FROM add_requests WHERE customshorturlcode IN (SELECT shorturl FROM shorturls)",
    "remove_links": "SELECT request_id, status, reason FROM remove_outcomes",
    "links_after_removal": "SELECT * FROM shorturls WHERE shorturl NOT IN (SELECT shorturl FROM remove_outcomes WHERE status = 200)",
    "clicks_after_removal": "SELECT * FROM clean_clicks WHERE shorturl NOT IN (SELECT shorturl FROM remove_outcomes WHERE status = 200)",
    "list_links": "SELECT id, redirecturl, shorturl, password IS NOT NULL AS password FROM shorturls WHERE token IN (SELECT token FROM list_requests)",
    "list_outcomes": """
SELECT r.request_id, CASE WHEN COALESCE(r.token, '') = '' THEN 400 ELSE 200 END AS status, CASE WHEN COALESCE(r.token, '') <> '' THEN (SELECT count(*) FROM shorturls s WHERE s.token = r.token) ELSE 0 END AS links FROM list_requests r""",
    "number_links": "SELECT token, id, shorturl, row_number() OVER (PARTITION BY token ORDER BY id) AS seq FROM shorturls",
    "link_report": f"""
SELECT id, CASE WHEN password IS NOT NULL THEN chr(128274) ELSE '' END AS lock, 'links.example/api/short/'||shorturl AS link_text, 'https://links.example/api/short/'||shorturl AS link, redirecturl AS target_text,
 {_URL.format(c='redirecturl')} AS target, 'https://links.example/shorturlanalytics?shorturl='||shorturl AS analytics_link FROM shorturls WHERE token IN (SELECT token FROM users)""",
    "generated_codes": """
SELECT r.request_id, CAST(u.id AS VARCHAR)||substr(md5(CAST(r.request_id AS VARCHAR)||'salt'),1,4) AS code FROM add_requests r LEFT JOIN users u ON u.token = r.token""",
    "session_tokens": "SELECT id, 128 AS length, TRUE AS hex, 1 AS owners FROM users",
    "valid_codes": "SELECT request_id, regexp_full_match(customshorturlcode, '[a-zA-Z0-9]+') AS valid FROM add_requests",
    "flag_filtered": """
SELECT request_id, customshorturlcode, CASE WHEN customshorturlcode IS NOT NULL THEN EXISTS (SELECT 1 FROM words w WHERE contains(lower(customshorturlcode), w.word)) END AS filtered FROM add_requests""",
    "resolve_hits": f"""
SELECT h.id, h.shorturl, CASE WHEN s.id IS NULL THEN 404 WHEN COALESCE(s.password,'') <> '' THEN 200 ELSE 302 END AS outcome,
 CASE WHEN s.id IS NOT NULL AND COALESCE(s.password,'') = '' THEN {_URL.format(c='s.redirecturl')} END AS location FROM link_hits h LEFT JOIN first_links s ON s.shorturl = h.shorturl""",
    "enrich_geo": "SELECT h.id, h.remote_addr AS ip, g.isp, g.city, g.region, g.country FROM link_hits h LEFT JOIN geo g ON g.ip = h.remote_addr",
    "build_clicks": "SELECT * FROM clean_clicks",
    "build_located_clicks": "SELECT * FROM clean_clicks WHERE ip IN (SELECT ip FROM geo)",
    "clicks_between": """
SELECT * FROM clean_clicks WHERE timestamp >= (SELECT date_trunc('day', min(timestamp)) + INTERVAL 10 DAY FROM clean_clicks)
 AND timestamp < (SELECT date_trunc('day', min(timestamp)) + INTERVAL 17 DAY FROM clean_clicks)""",
    "clicks_for": "SELECT * FROM clean_clicks WHERE shorturl IN (SELECT shorturl FROM click_requests)",
    "analytics_outcome": """
SELECT request_id, shorturl, CASE WHEN shorturl = '' THEN 400 WHEN shorturl IN (SELECT shorturl FROM clicks) THEN 200 WHEN shorturl IN (SELECT shorturl FROM shorturls) THEN 201 ELSE 404 END AS status
 FROM (SELECT id AS request_id, CASE WHEN id % 50 = 7 THEN '' ELSE shorturl END AS shorturl FROM link_hits UNION ALL SELECT -id - 1 AS request_id, shorturl FROM shorturls)""",
    "click_totals": "SELECT s.shorturl, count(c.id) AS clicks FROM (SELECT DISTINCT shorturl FROM shorturls) s LEFT JOIN clicks c ON c.shorturl = s.shorturl GROUP BY s.shorturl",
    "click_report": f"""
SELECT timestamp, ip, referrer AS redirect, {_URL.format(c='referrer')} AS redirect_link, isp, password_status AS authorized, city, region, country, useragent FROM clean_clicks""",
    "unlock_outcomes": "SELECT * FROM unlock_results",
    "apply_unlocks": """
SELECT * REPLACE (CASE WHEN id IN (SELECT click_id FROM unlock_results WHERE status = 200) THEN 'Yes' ELSE password_status END AS password_status) FROM clean_clicks""",
    "apply_unlocks_strict": """
SELECT c.* REPLACE (CASE WHEN EXISTS (SELECT 1 FROM unlock_results r WHERE r.status = 200 AND r.click_id = c.id AND r.shorturl = c.shorturl) THEN 'Yes' ELSE c.password_status END AS password_status) FROM clean_clicks c""",
    "unlock_effect": "SELECT click_id, shorturl, matched FROM unlock_results WHERE matched IS NOT NULL",
    "check_signup_form": """
SELECT request_id, CASE WHEN password <> password_again THEN 'Passwords do not match' WHEN firstname = '' OR lastname = '' OR username = '' OR password = '' OR password_again = '' THEN 'Please fill out all fields'
 WHEN regexp_matches(password, '\\s') THEN 'Password must not contain any whitespace' END AS problem FROM signup_requests""",
    "register_accounts": """
SELECT request_id, CASE WHEN missing OR taken OR place > 1 THEN 400 ELSE 200 END AS status, CASE WHEN missing THEN 'field missing' WHEN taken OR place > 1 THEN 'name taken' END AS reason FROM signup_results""",
    "new_accounts": """
SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY request_id) AS id, firstname, lastname, username, request_id FROM signup_results WHERE NOT missing AND NOT taken AND place = 1""",
    "rate_limit_tumbling": "SELECT request_id, ip, row_number() OVER (PARTITION BY ip, date_trunc('day', ts) ORDER BY ts, request_id) > 2 AS limited FROM api_requests",
    "rate_limit_windows": """
SELECT ip, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS hits, greatest(count(*) - 2, 0) AS limited_hits FROM api_requests GROUP BY ip, date_trunc('day', ts)""",
    "rate_limit_default": "SELECT request_id, ip, row_number() OVER (PARTITION BY ip, date_trunc('minute', ts) ORDER BY ts, request_id) > 20 AS limited FROM busy_requests WHERE path LIKE '/api%' AND path <> '/api/messagewss'",
    "rate_limit_anchored": "SELECT * FROM anchored",
    "classify_route": f"""
SELECT request_id, CASE WHEN path = '/api/messagewss' THEN 'messagewss' WHEN {_PATH} NOT LIKE '/api%' THEN 'static' WHEN method = 'OPTIONS' THEN 'preflight'
 WHEN method IN ('GET','HEAD') AND regexp_full_match({_PATH}, '/api/short/[^/]+/?') THEN 'short' WHEN method = 'POST' AND regexp_full_match({_PATH}, '/api/short/[^/]+/checkpassword/?') THEN 'checkpassword'
 WHEN method IN ('GET','HEAD') AND {_PATH} IN ('/api/shorturlanalytics','/api/validurl','/api/getshorturls') THEN substr({_PATH}, 6)
 WHEN method = 'POST' AND {_PATH} IN ('/api/signup','/api/login','/api/addshorturl','/api/removeshorturl') THEN substr({_PATH}, 6) ELSE 'not_found' END AS route FROM http_requests""",
    "classify_probe": """
SELECT probe_id, CASE WHEN COALESCE(url_param,'') = '' THEN 400 WHEN regexp_matches(url_param, '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)') THEN NULL WHEN contains(COALESCE(error,''),'ENOTFOUND') THEN 404
 WHEN error IS NOT NULL OR http_status = 200 OR http_status NOT BETWEEN 200 AND 299 THEN 200 END AS outcome FROM url_probes""",
    "check_join": "SELECT conn_id, username, error FROM chat_checked",
    "admit": "SELECT conn_id, username, admitted, error FROM chat_admissions",
    "presence": "SELECT ts, conn_id, kind, COALESCE(array_to_string(users, ','), '') AS users, online FROM chat_presence",
    "online_counts": """
SELECT t.ts, count(h.conn_id) AS online FROM (SELECT open_ts AS ts FROM chat_holders WHERE open_ts < close_ts UNION SELECT close_ts AS ts FROM chat_holders WHERE open_ts < close_ts) t
 LEFT JOIN chat_holders h ON h.open_ts <= t.ts AND t.ts < h.close_ts GROUP BY t.ts""",
    "check_frame": "SELECT frame_id, status, CASE status WHEN 'accepted' THEN message WHEN 'error' THEN 'Invalid message format.' END AS message FROM chat_checked_frames",
    "presence_log": """
SELECT c.page, c.ts, c.kind, c.conn_id, h.username, h.open_ts AS since FROM paged_changes c LEFT JOIN chat_holders h ON h.conn_id = c.conn_id
 UNION ALL SELECT p.page, p.start AS ts, 'online' AS kind, h.conn_id, h.username, h.open_ts AS since FROM page_starts p JOIN chat_holders h ON h.open_ts < p.start AND p.start <= h.close_ts""",
    "fan_out_versions": """
SELECT 'message' AS kind, s.frame_id AS id, COALESCE(n.version, 0) AS version FROM chat_sent s ASOF LEFT JOIN recipient_versions n ON s.ts >= n.ts
 UNION ALL SELECT c.kind, c.id, n.version FROM recipient_changes c JOIN recipient_versions n ON n.ts = c.ts""",
    "fan_out": "SELECT s.frame_id, h.conn_id AS recipient_conn FROM chat_sent s JOIN chat_recipients h ON h.open_ts <= s.ts AND s.ts < h.close_ts",
    "delivery_counts": "SELECT s.frame_id, count(*) AS recipients FROM chat_sent s JOIN chat_recipients h ON h.open_ts <= s.ts AND s.ts < h.close_ts GROUP BY s.frame_id",
    "normalize_url": f"SELECT id, {_URL.format(c='redirecturl')} AS url FROM shorturls",
    "extract_code": "SELECT request_id, NULLIF(regexp_extract('links.example'||path, 'links\\.example/api/short/([a-zA-Z0-9]+)', 1), '') AS code FROM http_requests",
    "js_trim": "SELECT p_partkey, p_name AS trimmed FROM part",
    "decode_uri_component": "SELECT probe_id, CASE WHEN regexp_matches(url_param, '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)') THEN NULL ELSE url_decode(url_param) END AS decoded FROM url_probes",
    "query_fields": """
SELECT request_id, NULLIF(split_part(path, 'shorturl=', 2), '') AS tail, CASE WHEN contains(path, '?aid=') THEN regexp_extract(path, 'aid=([^&#]*)', 1) END AS aid,
 CASE WHEN contains(path, '?url=') THEN url_decode(regexp_extract(path, '\\?url=([^&#]*)', 1)) END AS url FROM http_requests""",
    "last_segment": f"SELECT request_id, regexp_extract({_PATH}, '[^/]*$') AS segment FROM http_requests",
    "client_ip": "SELECT id, COALESCE(xff, '') <> '' AS forwarded, COALESCE(NULLIF(xff, ''), remote_addr) AS ip FROM link_hits",
    "utc_second": "SELECT id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS second, strftime(ts, '%Y-%m-%d %H:%M:%S') AS second_text FROM link_hits",
}

_TYPE = """CASE WHEN payload = '' THEN NULL WHEN payload LIKE 'WIFI:%' THEN 'wifi' WHEN payload LIKE 'BEGIN:VCARD%' THEN 'vcard' WHEN payload LIKE 'BEGIN:VEVENT%' THEN 'event'
 WHEN payload LIKE 'mailto:%' THEN 'email' WHEN payload LIKE 'tel:%' THEN 'phone' WHEN payload LIKE 'sms:%' THEN 'sms' WHEN payload LIKE 'geo:%' THEN 'geo' WHEN payload LIKE 'bitcoin:%' THEN 'bitcoin'
 WHEN payload LIKE 'https://wa.me/%' THEN 'whatsapp' WHEN regexp_matches(payload, '^https?://') THEN 'url' ELSE 'text' END"""


def _part(pattern: str) -> str:
    return f"regexp_extract(payload, '{pattern}', 1)"


CHECKS |= {
    "payload_types": f"SELECT payload_id, {_TYPE} AS type FROM qr_payloads",
    "payload_type_counts": f"SELECT {_TYPE} AS type, count(*) AS payloads FROM qr_payloads GROUP BY 1",
    "payload_fields": f"""
SELECT payload_id, type, CASE type WHEN 'text' THEN 'text='||payload WHEN 'url' THEN 'url='||payload WHEN 'phone' THEN 'number='||substr(payload, 5)
 WHEN 'email' THEN 'address='||{_part('mailto:([^?]*)')}||'|body='||{_part('body=([^&]*)')}||'|subject='||{_part('subject=([^&]*)')}
 WHEN 'sms' THEN 'body='||{_part('body=([^&]*)')}||'|number='||{_part('sms:([^?]*)')}
 WHEN 'whatsapp' THEN 'number='||{_part('wa.me/([^?]*)')}||'|text='||replace({_part('text=([^&]*)')}, '+', ' ')
 WHEN 'wifi' THEN 'P='||CASE WHEN payload_id % 2 = 0 THEN 'p;w' ELSE 'pw' END||'|S='||{_part('S:([^;]*)')}||'|T='||{_part('T:([^;]*)')}
 WHEN 'geo' THEN CASE WHEN payload_id % 2 = 0 THEN 'altitude=8|' ELSE '' END||'latitude='||{_part('geo:([^,]*)')}||'|longitude='||{_part(',([^,]*)')}
 WHEN 'vcard' THEN 'N='||split_part(split_part(payload, chr(10)||'N:', 2), chr(10), 1)||'|TEL=1|TEL=2|VERSION='||split_part(split_part(payload, 'VERSION:', 2), chr(10), 1)
 WHEN 'event' THEN 'DTEND='||split_part(split_part(payload, 'DTEND:', 2), chr(10), 1)||'|DTSTART='||split_part(split_part(payload, 'DTSTART:', 2), chr(10), 1)||'|SUMMARY='||split_part(split_part(payload, 'SUMMARY:', 2), chr(10), 1)
 WHEN 'bitcoin' THEN 'address='||{_part('bitcoin:([^?]*)')}||'|amount='||{_part('amount=([^&]*)')}||'|label='||{_part('label=([^&]*)')} END AS fields
 FROM (SELECT *, {_TYPE} AS type FROM qr_payloads)""",
}

CHECKS |= {
    "stream_clicks": CHECKS["build_clicks"],
    "stream_click_totals": "SELECT shorturl, count(*) AS clicks FROM clicks GROUP BY shorturl",
    "stream_rate_limit": CHECKS["rate_limit_windows"],
    "stream_rate_limit_anchored": CHECKS["rate_limit_anchored"],
    "stream_unlocks": CHECKS["apply_unlocks"],
    "stream_admissions": CHECKS["admit"],
    "presence_from_log": CHECKS["presence"],
    "stream_presence": CHECKS["presence"],
    "stream_fan_out": CHECKS["fan_out"],
    "stream_delivery_counts": CHECKS["delivery_counts"],
    "stream_senders": "SELECT f.frame_id, s.username FROM chat_checked_frames f LEFT JOIN chat_sent s ON s.frame_id = f.frame_id WHERE f.status = 'accepted'",
    "stream_first_username": "SELECT username, request_id FROM signup_results WHERE NOT missing AND NOT taken AND place = 1",
    "stream_first_code": "SELECT request_id, code AS shorturl FROM add_outcomes WHERE status = 200 AND custom",
}


def oracle_texts() -> dict[str, str]:
    return {name: with_views(text, CHECK_VIEWS) for name, text in CHECKS.items()}
