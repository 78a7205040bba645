"""The same answers in SQL, written independently of the Spark operators, for the correctness gate.

Sequential operators are walked row by row with recursive queries.
"""

from wayfold.catalog import FROM, NOW, TO
from wayfold.fixtures import EPOCH_US, positions_sql

HOUR = 3_600_000_000
# One day before the latest acceptable time in the validation queries.
SKEW_LIMIT = EPOCH_US + 48 * HOUR


def hav(a, b, c, d):
    return (
        f"2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * "
        f"cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"
    )


def flat(a, b, c, d):
    return (
        f"sqrt(pow(({c} - {a}) * 111320.0, 2) + pow(({d} - {b}) * 111320.0 * cos(radians({c})), 2))"
    )


def stops_cte(name="dstops", source="pos", dwell=120, where="true"):
    """Server-side stops: from an anchor, either jump past its run or go on by one sample."""
    p = name
    return f"""
{p}_s AS (SELECT vehicle_id, reading_id, us, lat, lon,
            row_number() OVER (PARTITION BY vehicle_id ORDER BY us, reading_id) AS i,
            count(*) OVER (PARTITION BY vehicle_id) AS n FROM {source} WHERE {where}),
{p}_out AS (SELECT a.vehicle_id, a.i, min(b.i) AS j FROM {p}_s a JOIN {p}_s b
            ON a.vehicle_id = b.vehicle_id AND b.i > a.i AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} > 50
            GROUP BY 1, 2),
{p}_q AS (SELECT a.*, coalesce(o.j, a.n + 1) AS j, z.us AS last_us, z.us - a.us >= {dwell}000000 AS is_stop
          FROM {p}_s a LEFT JOIN {p}_out o ON a.vehicle_id = o.vehicle_id AND a.i = o.i
          JOIN {p}_s z ON z.vehicle_id = a.vehicle_id AND z.i = coalesce(o.j, a.n + 1) - 1),
{p}_w AS (SELECT vehicle_id, i FROM {p}_q WHERE i = 1
          UNION ALL
          SELECT w.vehicle_id, CASE WHEN q.is_stop THEN q.j ELSE w.i + 1 END FROM {p}_w w
          JOIN {p}_q q ON q.vehicle_id = w.vehicle_id AND q.i = w.i
          WHERE CASE WHEN q.is_stop THEN q.j ELSE w.i + 1 END <= q.n),
{p} AS (SELECT sha256('stop|' || q.vehicle_id || '|' || q.us) AS id, q.vehicle_id, q.us AS arrived_us,
          CASE WHEN q.j <= q.n THEN q.last_us END AS departed_us, q.lat, q.lon
        FROM {p}_w w JOIN {p}_q q ON q.vehicle_id = w.vehicle_id AND q.i = w.i WHERE q.is_stop)"""


def trips_cte(name="dtrips", stops="dstops"):
    p = name
    return f"""
{p}_p AS (SELECT s.*, EXISTS (SELECT 1 FROM {stops} d WHERE d.vehicle_id = s.vehicle_id
            AND s.us >= d.arrived_us AND (d.departed_us IS NULL OR s.us <= d.departed_us)) AS parked
          FROM {stops}_s s),
{p}_l AS (SELECT *, lag(us) OVER v AS p_us, lag(lat) OVER v AS p_lat, lag(lon) OVER v AS p_lon,
            lag(parked) OVER v AS p_parked FROM {p}_p WINDOW v AS (PARTITION BY vehicle_id ORDER BY i)),
{p}_b AS (SELECT *, NOT parked AND (p_us IS NULL OR p_parked OR us - p_us > 600000000) AS starts FROM {p}_l),
{p}_g AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY i) AS trip
          FROM {p}_b),
{p} AS (SELECT sha256('trip|' || vehicle_id || '|' || min(us)) AS id, vehicle_id, min(us) AS started_us,
          max(us) AS ended_us,
          sum(CASE WHEN starts THEN 0 ELSE {hav('p_lat', 'p_lon', 'lat', 'lon')} END) AS distance_m
        FROM {p}_g WHERE NOT parked GROUP BY vehicle_id, trip HAVING count(*) >= 2)"""


CLIENT = f"""
fx AS (SELECT vehicle_id, us, lat, lon, (speed_mps IS NULL OR speed_mps <= 1) AS still,
         row_number() OVER (PARTITION BY vehicle_id ORDER BY us, reading_id) AS k
       FROM pos WHERE accuracy_m IS NULL OR accuracy_m <= 50),
walk AS (SELECT DISTINCT vehicle_id, 0::BIGINT AS k, NULL::DOUBLE AS a_lat, NULL::DOUBLE AS a_lon,
           NULL::BIGINT AS a_us, NULL::BIGINT AS last_us, false AS is_open, NULL::VARCHAR AS kind,
           NULL::DOUBLE AS e_lat, NULL::DOUBLE AS e_lon, NULL::BIGINT AS e_us, NULL::BIGINT AS e_left FROM fx
  UNION ALL
  SELECT vehicle_id, k,
    CASE WHEN inside THEN a_lat WHEN still THEN lat END, CASE WHEN inside THEN a_lon WHEN still THEN lon END,
    CASE WHEN inside THEN a_us WHEN still THEN us END, CASE WHEN inside OR still THEN us END,
    inside AND (is_open OR us - a_us >= 90000000),
    CASE WHEN inside AND NOT is_open AND us - a_us >= 90000000 THEN 'arrived'
         WHEN NOT inside AND is_open THEN 'departed' END,
    a_lat, a_lon, a_us, CASE WHEN NOT inside AND is_open THEN last_us END
  FROM (SELECT w.vehicle_id, f.k, w.a_lat, w.a_lon, w.a_us, w.last_us, w.is_open, f.us, f.lat, f.lon, f.still,
          (w.a_us IS NOT NULL AND {hav('w.a_lat', 'w.a_lon', 'f.lat', 'f.lon')} <= 50) AS inside
        FROM walk w JOIN fx f ON f.vehicle_id = w.vehicle_id AND f.k = w.k + 1)),
emitted AS (SELECT sha256('client|' || vehicle_id || '|' || e_us) AS event_id, vehicle_id, kind,
              e_us AS arrived_us, e_left AS departed_us, e_lat AS lat, e_lon AS lon
            FROM walk WHERE kind IS NOT NULL),
cstops AS (SELECT event_id AS id, vehicle_id, arrived_us, max(departed_us) AS departed_us, lat, lon
           FROM emitted GROUP BY ALL)"""


def match_cte(name="matched", client="cstops", derived="dstops", metres=100, seconds=120):
    """Greedy pairs: walk the candidates of a vehicle in order, carrying what is taken."""
    p = name
    return f"""
{p}_c AS (SELECT * , abs(secs) / {seconds} + dm / {metres} AS score FROM (
            SELECT c.vehicle_id, c.id AS cid, d.id AS did, c.arrived_us AS client_us, d.arrived_us AS derived_us,
              (c.arrived_us - d.arrived_us) / 1e6 AS secs, {hav('c.lat', 'c.lon', 'd.lat', 'd.lon')} AS dm
            FROM {client} c JOIN {derived} d ON c.vehicle_id = d.vehicle_id
              AND abs(c.arrived_us - d.arrived_us) <= {seconds}000000) WHERE dm <= {metres}),
{p}_r AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY score, client_us, cid, derived_us, did) AS k
          FROM {p}_c),
{p}_w AS (SELECT DISTINCT vehicle_id, 0::BIGINT AS k, []::VARCHAR[] AS taken, false AS ok FROM {p}_r
          UNION ALL
          SELECT vehicle_id, k, CASE WHEN free THEN list_concat(taken, [cid, did]) ELSE taken END, free
          FROM (SELECT w.vehicle_id, r.k, w.taken, r.cid, r.did,
                  NOT list_contains(w.taken, r.cid) AND NOT list_contains(w.taken, r.did) AS free
                FROM {p}_w w JOIN {p}_r r ON r.vehicle_id = w.vehicle_id AND r.k = w.k + 1)),
{p} AS (SELECT r.vehicle_id, r.cid AS client_event_id, r.did AS derived_event_id, client_us, derived_us,
          CAST(round(secs) AS BIGINT) AS delta_seconds, dm FROM {p}_w w
        JOIN {p}_r r ON r.vehicle_id = w.vehicle_id AND r.k = w.k WHERE w.ok)"""


def q(*parts):
    *ctes, final = parts
    return "WITH RECURSIVE " + ",".join([positions_sql(), *ctes]) + "\n" + final


STOPS = stops_cte()
TRIPS = trips_cte()
LINKED = """
linked AS (SELECT d.*, (SELECT t.id FROM dtrips t WHERE t.vehicle_id = d.vehicle_id
             AND t.ended_us <= d.arrived_us ORDER BY t.ended_us DESC, t.started_us LIMIT 1) AS trip_id
           FROM dstops d)"""
MATCHED = match_cte()
ALL = """
alls AS (SELECT 'client' AS source, * FROM cstops UNION ALL BY NAME SELECT 'derived' AS source, * FROM dstops)"""
VEHICLES = """
veh AS (SELECT id, 'dev-' || id AS external_id, id AS label FROM (
          SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events
          UNION ALL SELECT DISTINCT 'silent-' || user_id FROM events WHERE user_id % 7 = 0)),
vlast AS (SELECT v.*, (SELECT max(us) FROM pos p WHERE p.vehicle_id = v.id) AS last_reported_us FROM veh v)"""
WINDOW = f"us >= {FROM} AND us < {TO}"

FLAWED = """
flaw AS (SELECT event_id, vehicle_id, us,
  CASE WHEN event_id % 101 = 0 THEN NULL ELSE reading_id END AS reading_id,
  CASE WHEN event_id % 103 = 0 THEN us + 176400000000 ELSE us END AS recorded_us,
  CASE WHEN event_id % 107 = 0 THEN 91.5 WHEN event_id % 109 = 0 THEN 'nan'::double ELSE lat END AS lat,
  CASE WHEN event_id % 113 = 0 THEN -181.0 ELSE lon END AS lon,
  CASE WHEN event_id % 127 = 0 THEN -1.0 ELSE speed_mps END AS speed_mps,
  CASE WHEN event_id % 131 = 0 THEN 361.0 ELSE heading_deg END AS heading_deg,
  CASE WHEN event_id % 137 = 0 THEN -5.0 ELSE accuracy_m END AS accuracy_m,
  CASE WHEN event_id % 139 = 0 THEN 101 ELSE battery_pct END AS battery_pct,
  CASE WHEN event_id % 149 = 0 THEN 'flying' ELSE motion_state END AS motion_state FROM pos)"""
JUDGED = FLAWED + f""",
judged AS (SELECT *, CASE
  WHEN reading_id IS NULL THEN 'reading_id is required'
  WHEN recorded_us > {SKEW_LIMIT} THEN 'recorded_at is more than 24h0m0s in the future'
  WHEN event_id % 107 = 0 THEN 'lat 91.5 out of range [-90, 90]'
  WHEN lon = -181 THEN 'lon -181 out of range [-180, 180]'
  WHEN isnan(lat) THEN 'lat/lon must be finite numbers'
  WHEN speed_mps < 0 THEN 'speed_mps -1 must be a finite non-negative number'
  WHEN heading_deg > 360 THEN 'heading_deg 361 out of range [0, 360]'
  WHEN accuracy_m < 0 THEN 'accuracy_m -5 must be a finite non-negative number'
  WHEN battery_pct > 100 THEN 'battery_pct 101 out of range [0, 100]'
  WHEN motion_state = 'flying' THEN 'motion_state "flying" is not recognised' END AS reason FROM flaw)"""
REPORTS = """
rep AS (SELECT id, vehicle_id, arrived_us, NULL::BIGINT AS departed_us, lat, lon, arrived_us % 2 AS seq FROM cstops
        UNION ALL SELECT id, vehicle_id, arrived_us, departed_us, lat + 1, lon, 1 - arrived_us % 2 FROM cstops
          WHERE departed_us IS NOT NULL
        UNION ALL SELECT id, vehicle_id, arrived_us, NULL, lat, lon, 2 FROM cstops),
col AS (SELECT * FROM rep QUALIFY row_number() OVER (PARTITION BY id ORDER BY departed_us IS NULL, seq) = 1),
snap AS (SELECT id, vehicle_id, arrived_us, NULL::BIGINT AS departed_us, lat FROM cstops WHERE arrived_us % 3 = 0)"""
QUEUE = """
que AS (SELECT 'q' || reading_id AS id, 'dev-' || vehicle_id AS device_id, event_id AS n, user_id,
          CASE WHEN event_id % 5 < 2 THEN 'e' || (event_id // 5) ELSE reading_id END AS wire,
          event_id % 6 AS attempts, us AS created_us,
          'dev-' || vehicle_id || '-' || (event_id % 7) AS batch_id,
          (user_id + event_id % 7) % 4 AS o FROM pos),
ref AS (SELECT DISTINCT batch_id, wire FROM que WHERE n % 25 < 5),
ack AS (SELECT q.*, CASE WHEN r.wire IS NULL THEN 'accepted' ELSE 'rejected' END AS named
        FROM que q LEFT JOIN ref r ON q.batch_id = r.batch_id AND q.wire = r.wire),
plan AS (SELECT *, CASE o WHEN 0 THEN 'accepted' WHEN 1 THEN 'shed' WHEN 2 THEN 'rejected' ELSE 'unavailable' END AS outcome,
           CASE WHEN o = 0 AND n % 11 <> 0 THEN named END AS verdict,
           CASE WHEN o = 0 THEN CASE WHEN n % 11 <> 0 THEN 'remove' ELSE 'fail' END WHEN o = 1 THEN 'keep'
                WHEN o = 2 AND attempts + 1 >= 5 THEN 'quarantine' ELSE 'fail' END AS action,
           sum(CASE WHEN n % 11 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id) AS missing FROM ack),
act AS (SELECT *, CASE WHEN o = 0 AND missing > 0 THEN missing || ' item(s) missing from the server response'
                       WHEN o = 1 THEN 'server shed load' WHEN o >= 2 THEN 'reason ' || o END AS error FROM plan)"""
SIDES = """
loc AS (SELECT * FROM pos WHERE event_id % 3 <> 0),
srv AS (SELECT * REPLACE (lat + 1 AS lat) FROM pos WHERE event_id % 5 <> 0),
mrg AS (SELECT * FROM srv UNION ALL SELECT * FROM loc WHERE reading_id NOT IN (SELECT reading_id FROM srv))"""


def thin_cte(name="thinned", source="pos", where="true"):
    """Walk a route, keeping a point once it is 15 m from the last one kept."""
    p = name
    return f"""
{p}_s AS (SELECT vehicle_id, reading_id, us, lat, lon,
            row_number() OVER (PARTITION BY vehicle_id ORDER BY us, reading_id) AS i,
            count(*) OVER (PARTITION BY vehicle_id) AS n FROM {source} WHERE {where}),
{p}_w AS (SELECT vehicle_id, i, reading_id, us, n, true AS keep, lat AS k_lat, lon AS k_lon FROM {p}_s WHERE i = 1
          UNION ALL
          SELECT vehicle_id, i, reading_id, us, n, far, CASE WHEN far THEN lat ELSE k_lat END,
            CASE WHEN far THEN lon ELSE k_lon END
          FROM (SELECT s.*, w.k_lat, w.k_lon, {flat('w.k_lat', 'w.k_lon', 's.lat', 's.lon')} >= 15 AS far
                FROM {p}_w w JOIN {p}_s s ON s.vehicle_id = w.vehicle_id AND s.i = w.i + 1)),
{p} AS (SELECT vehicle_id, reading_id, us FROM {p}_w WHERE keep OR i = n OR n <= 2)"""


CAMERA = """
    round(coalesce((min(lat) + max(lat)) / 2, 49.2827), 6) AS latitude,
    round(coalesce((min(lon) + max(lon)) / 2, -123.1207), 6) AS longitude,
    CAST(CASE WHEN greatest(max(lat) - min(lat), max(lon) - min(lon)) <= 0 THEN 16
      ELSE greatest(2, least(18, floor(log2(360.0 / (greatest((max(lat) - min(lat)) * 1.2, (max(lon) - min(lon)) * 1.2))))))
      END AS BIGINT) AS zoom"""


def drain_sql(rows, stationary):
    return q(
        f"""
b AS ({rows}),
hrs AS (SELECT vehicle_id, us // {HOUR} AS h, count(*) AS fixes, count(*) FILTER (motion_state = 'driving') AS driving
        FROM b GROUP BY ALL),
prs AS (SELECT vehicle_id, us // {HOUR} AS h, (us - lag(us) OVER v) / 1e6 AS secs, lag(battery_pct) OVER v - battery_pct AS spent
        FROM b WHERE battery_pct IS NOT NULL WINDOW v AS (PARTITION BY vehicle_id ORDER BY us, reading_id)),
uh AS (SELECT vehicle_id, h, sum(secs) AS secs, sum(spent) AS spent FROM prs WHERE spent >= 0 AND secs <= 1800 GROUP BY ALL)""",
        f"""SELECT band, count(*) AS vehicle_hours, round(sum(secs) / 3600, 3) AS hours, CAST(sum(spent) AS BIGINT) AS spent_pct,
  round(sum(spent) / (sum(secs) / 3600), 3) AS drain_pct_per_hour
FROM (SELECT uh.*, CASE WHEN fixes BETWEEN 20 AND 24 THEN '20-24' WHEN fixes BETWEEN 25 AND 29 THEN '25-29'
        WHEN fixes >= 30 THEN '30+' END AS band FROM uh JOIN hrs USING (vehicle_id, h) WHERE {'driving = 0' if stationary else 'true'})
WHERE band IS NOT NULL GROUP BY band""",
    )


READINGS = (
    "SELECT 'dev-' || vehicle_id AS device_id, reading_id, us AS recorded_us, lat, lon, "
    "round(CAST(speed_mps AS DOUBLE), 3) AS speed_mps, CAST(battery_pct AS BIGINT) AS battery_pct, motion_state FROM pos"
)
EMISSIONS = "SELECT event_id, vehicle_id, kind, arrived_us, departed_us, lat, lon FROM emitted"
QUEUED = """
items AS (SELECT 'dev-' || vehicle_id AS device_id, us AS queued_us, 'r' || reading_id AS tie, speed_mps IS NULL AS no_speed, true AS is_reading FROM pos
          UNION ALL SELECT 'dev-' || vehicle_id, coalesce(departed_us, arrived_us), 's' || event_id, false, false FROM emitted),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY device_id ORDER BY queued_us, tie) - 1) // 50 AS batch_no FROM items)"""
MEANS = """round(coalesce(avg(abs(delta_seconds)), 0), 3) AS mean_abs_delta_seconds,
  round(coalesce(avg(delta_seconds), 0), 3) AS mean_signed_delta_seconds, round(coalesce(avg(dm), 0), 3) AS mean_delta_meters"""
REPLACED = (
    stops_cte("nstops", "pos", 240, WINDOW) + "," + trips_cte("ntrips", "nstops") + f""",
act_v AS (SELECT DISTINCT vehicle_id FROM pos WHERE {WINDOW})"""
)


def overlap(start, end):
    return f"({start} < {TO} AND coalesce({end}, {NOW}) >= {FROM})"


ORACLE = {
    "trip_report": q(STOPS, TRIPS, "SELECT vehicle_id, count(*) AS trips, round(sum(distance_m), 3) AS distance_m FROM dtrips GROUP BY 1"),
    "stop_detection": q(STOPS, "SELECT id, vehicle_id, arrived_us, departed_us, lat, lon FROM dstops"),
    "trip_detection": q(STOPS, TRIPS, "SELECT id, vehicle_id, started_us, ended_us, round(distance_m, 3) AS distance_m FROM dtrips"),
    "arriving_trip": q(STOPS, TRIPS, LINKED, "SELECT vehicle_id, arrived_us, trip_id FROM linked"),
    "parked_samples": q(STOPS, TRIPS, "SELECT vehicle_id, reading_id, parked FROM dtrips_p"),
    "sample_steps": q(
        "l AS (SELECT *, lag(us) OVER v AS p_us, lag(lat) OVER v AS p_lat, lag(lon) OVER v AS p_lon FROM pos "
        "WINDOW v AS (PARTITION BY vehicle_id ORDER BY us, reading_id)), "
        f"d AS (SELECT *, (us - p_us) / 1e6 AS gap, {hav('p_lat', 'p_lon', 'lat', 'lon')} AS step FROM l)",
        "SELECT vehicle_id, reading_id, us - p_us AS gap_us, round(step, 3) AS step_m, "
        "round(CASE WHEN gap > 0 THEN step / gap END, 3) AS step_mps FROM d",
    ),
    "client_stop_detection": q(CLIENT, EMISSIONS),
    "client_stop_stream": q(CLIENT, EMISSIONS),
    "client_stop_table": q(CLIENT, "SELECT vehicle_id, arrived_us, departed_us, lat, lon FROM cstops"),
    "emission_counts": q(
        CLIENT,
        "SELECT vehicle_id, count(*) FILTER (kind = 'arrived') AS arrived, count(*) FILTER (kind = 'departed') AS departed, "
        "count(*) FILTER (kind = 'arrived') > count(*) FILTER (kind = 'departed') AS open FROM emitted GROUP BY 1",
    ),
    "windowed_derivation": q(
        stops_cte("dstops", "pos", 120, WINDOW), TRIPS, CLIENT,
        f"creps AS (SELECT * FROM cstops WHERE {overlap('arrived_us', 'departed_us')} "
        f"AND vehicle_id IN (SELECT vehicle_id FROM pos WHERE {WINDOW}))",
        match_cte("matched", "creps", "dstops"),
        f"SELECT (SELECT count(DISTINCT vehicle_id) FROM pos WHERE {WINDOW}) AS vehicles, (SELECT count(*) FROM dtrips) AS trips, "
        "(SELECT count(*) FROM dstops) AS derived_stops, (SELECT count(*) FROM creps) AS client_stops, "
        "(SELECT count(*) FROM matched) AS matched, (SELECT count(*) FROM creps) - (SELECT count(*) FROM matched) AS client_only, "
        "(SELECT count(*) FROM dstops) - (SELECT count(*) FROM matched) AS derived_only",
    ),
    "stored_run": q(
        stops_cte("dstops", "pos", 120, WINDOW), TRIPS, CLIENT,
        f"creps AS (SELECT * FROM cstops WHERE {overlap('arrived_us', 'departed_us')} "
        f"AND vehicle_id IN (SELECT vehicle_id FROM pos WHERE {WINDOW}))",
        match_cte("matched", "creps", "dstops"),
        "SELECT 'trips' AS kept_in, id, vehicle_id AS other FROM dtrips UNION ALL SELECT 'stop_events', id, 'derived' FROM dstops "
        "UNION ALL SELECT 'stop_events', id, 'client' FROM cstops UNION ALL SELECT 'matches', client_event_id, derived_event_id FROM matched",
    ),
    "match_candidates": q(
        STOPS, CLIENT, MATCHED,
        "SELECT vehicle_id, client_us, derived_us, CAST(round(secs) AS BIGINT) AS delta_seconds, round(dm, 3) AS delta_meters, "
        "round(score, 6) AS score FROM matched_c",
    ),
    "stop_matches": q(
        STOPS, CLIENT, MATCHED,
        "SELECT vehicle_id, client_event_id, derived_event_id, delta_seconds, round(dm, 3) AS delta_meters FROM matched",
    ),
    "contested_matches": q(
        STOPS, CLIENT, match_cte(metres=5000, seconds=1800),
        "SELECT vehicle_id, client_event_id, derived_event_id, delta_seconds, round(dm, 3) AS delta_meters FROM matched",
    ),
    "window_resolution": q(
        *[
            f"{name} AS (SELECT '{name[2:]}' AS asked, count(*) AS positions, count(DISTINCT vehicle_id) AS vehicles FROM pos "
            f"WHERE us >= {EPOCH_US} + {low} * {HOUR} // 2 AND us < {EPOCH_US} + {high} * {HOUR} // 2)"
            for name, low, high in (("w_both", 1, 3), ("w_from", 2, 6), ("w_none", -42, 6))
        ],
        "SELECT * FROM w_both UNION ALL SELECT * FROM w_from UNION ALL SELECT * FROM w_none",
    ),
    "matches_in_window": q(
        STOPS, CLIENT, MATCHED,
        f"SELECT client_event_id, derived_event_id, delta_seconds FROM matched WHERE client_us >= {FROM} AND client_us < {TO}",
    ),
    "unmatched_stops": q(
        STOPS, CLIENT, MATCHED, ALL,
        "SELECT source, vehicle_id, arrived_us FROM alls WHERE id NOT IN (SELECT client_event_id FROM matched) "
        "AND id NOT IN (SELECT derived_event_id FROM matched)",
    ),
    "reconciliation_summary": q(
        STOPS, CLIENT, MATCHED, ALL,
        f"w AS (SELECT * FROM alls WHERE arrived_us >= {FROM} AND arrived_us < {TO}), "
        "mt AS (SELECT * FROM matched WHERE client_event_id IN (SELECT id FROM w WHERE source = 'client'))",
        f"""SELECT (SELECT count(*) FROM w WHERE source = 'client') AS client_stops,
  (SELECT count(*) FROM w WHERE source = 'derived') AS derived_stops, count(*) AS matched,
  (SELECT count(*) FROM w WHERE source = 'client' AND id NOT IN (SELECT client_event_id FROM mt)) AS client_only,
  (SELECT count(*) FROM w WHERE source = 'derived' AND id NOT IN (SELECT derived_event_id FROM mt)) AS derived_only,
  {MEANS} FROM mt""",
    ),
    "vehicle_agreement": q(
        STOPS, CLIENT, MATCHED, ALL,
        f"c AS (SELECT vehicle_id, count(*) FILTER (source = 'client') AS client_stops, count(*) FILTER (source = 'derived') AS derived_stops FROM alls GROUP BY 1), "
        f"mt AS (SELECT vehicle_id, count(*) AS matched, {MEANS} FROM matched GROUP BY 1)",
        """SELECT vehicle_id, client_stops, derived_stops, coalesce(matched, 0) AS matched, client_stops - coalesce(matched, 0) AS client_only,
  derived_stops - coalesce(matched, 0) AS derived_only, coalesce(mean_abs_delta_seconds, 0) AS mean_abs_delta_seconds,
  coalesce(mean_signed_delta_seconds, 0) AS mean_signed_delta_seconds, coalesce(mean_delta_meters, 0) AS mean_delta_meters
FROM c LEFT JOIN mt USING (vehicle_id)""",
    ),
    "both_sources": q(
        STOPS, CLIENT, ALL,
        "SELECT vehicle_id, source, count(*) AS stops, count(*) FILTER (departed_us IS NULL) AS open_stops FROM alls GROUP BY ALL",
    ),
    "derivation_scan": q(f"SELECT vehicle_id, us AS recorded_us, lat, lon, round(CAST(speed_mps AS DOUBLE), 3) AS speed_mps FROM pos WHERE {WINDOW}"),
    "active_vehicles": q(f"SELECT DISTINCT vehicle_id FROM pos WHERE {WINDOW}"),
    "position_pages": q(
        f"w AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY us, reading_id) AS seq, count(*) OVER (PARTITION BY vehicle_id) AS c FROM pos WHERE {WINDOW})",
        "SELECT vehicle_id, seq, reading_id, us AS recorded_us, c > 20 AS truncated FROM w WHERE seq <= 20",
    ),
    "local_history": q(
        f"w AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY us, reading_id) AS seq FROM pos WHERE us >= {FROM})",
        "SELECT vehicle_id, seq, reading_id, us AS recorded_us FROM w WHERE seq <= 25",
    ),
    "vehicle_trips": q(STOPS, TRIPS, f"SELECT vehicle_id, started_us, ended_us, round(distance_m, 3) AS distance_m FROM dtrips WHERE {overlap('started_us', 'ended_us')}"),
    "vehicle_stops": q(STOPS, CLIENT, ALL, f"SELECT vehicle_id, arrived_us, departed_us, source FROM alls WHERE source = 'derived' AND {overlap('arrived_us', 'departed_us')}"),
    "vehicle_list": q(VEHICLES, "SELECT id, external_id, last_reported_us FROM vlast"),
    "last_reports": q("SELECT vehicle_id, max(us) AS last_reported_us FROM pos GROUP BY 1"),
    "most_recent_vehicle": q(VEHICLES, "SELECT id, last_reported_us FROM vlast ORDER BY last_reported_us DESC NULLS LAST, external_id LIMIT 1"),
    "latest_positions": q("SELECT vehicle_id, reading_id, us AS recorded_us, lat, lon, motion_state FROM pos QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY us DESC, reading_id DESC) = 1"),
    "last_fixes": q(
        "SELECT vehicle_id, count(*) OVER (PARTITION BY vehicle_id) AS fixes, round(lat, 5) AS lat, round(lon, 5) AS lon, CAST(floor(accuracy_m + 0.5) AS BIGINT) AS accuracy_m, "
        "us AS recorded_us FROM pos QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY us DESC, reading_id DESC) = 1"
    ),
    "position_count": q("SELECT count(*) AS positions FROM pos"),
    "active_days": """WITH d AS (SELECT CAST(user_id AS VARCHAR) AS vehicle_id,
    strftime(date_trunc('day', ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Vancouver'), '%Y-%m-%d') AS day,
    count(*) AS fixes, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1, 2)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY day DESC) <= 10""",
    "trip_distance_per_day": q(STOPS, TRIPS, "SELECT vehicle_id, strftime(make_timestamp(started_us), '%Y-%m-%d') AS day, count(*) AS trips, round(sum(distance_m), 3) AS distance_m FROM dtrips GROUP BY 1, 2"),
    "route_bounds": q("SELECT vehicle_id, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat, round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon FROM pos GROUP BY 1"),
    "route_camera": q(f"SELECT vehicle_id, {CAMERA} FROM pos GROUP BY 1"),
    "route_thinning": q(thin_cte(), "SELECT vehicle_id, reading_id, us AS recorded_us FROM thinned"),
    "route_merge": q(SIDES, "SELECT vehicle_id, reading_id, us AS recorded_us, round(lat, 6) AS lat FROM mrg"),
    "route_merge_stats": q(
        SIDES,
        "c AS (SELECT vehicle_id, count(*) FILTER (event_id % 3 <> 0) AS local_rows, count(*) FILTER (event_id % 5 <> 0) AS server_rows, "
        "count(*) FILTER (event_id % 3 <> 0 AND event_id % 5 = 0) AS local_only FROM pos GROUP BY 1)",
        "SELECT *, CASE WHEN local_rows > 0 AND server_rows > 0 THEN 'both' WHEN server_rows > 0 THEN 'server' ELSE 'local' END AS source, "
        "CASE WHEN server_rows = 0 THEN 'local only' WHEN local_only > 0 THEN 'synced · ' || local_only || ' pending' ELSE 'synced' END AS status "
        "FROM c WHERE local_rows + server_rows > 0",
    ),
    "route_screen": q(
        SIDES, thin_cte("thinned", "mrg", WINDOW),
        f"cam AS (SELECT vehicle_id, {CAMERA} FROM mrg WHERE {WINDOW} GROUP BY 1)",
        "SELECT vehicle_id, count(*) AS points, any_value(latitude) AS latitude, any_value(zoom) AS zoom FROM thinned JOIN cam USING (vehicle_id) GROUP BY 1",
    ),
    "distances": q(f"SELECT reading_id, round({hav('49.0', '(-123.0)', 'lat', 'lon')}, 3) AS great_circle_m, round({flat('49.0', '(-123.0)', 'lat', 'lon')}, 3) AS flat_m FROM pos"),
    "reading_mapping": """WITH raw AS (SELECT event_id,
    CASE WHEN event_id % 17 <> 0 THEN CAST(event_id % 400 - 10 AS DOUBLE) END AS heading,
    CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 50 - 5 AS DOUBLE) / 10 END AS speed,
    CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 120 - 5 AS DOUBLE) / 100 END AS level,
    event_id % 7 = 0 AS charging FROM events),
  m AS (SELECT *, CASE WHEN speed IS NULL OR speed < 0 THEN 'unknown' WHEN speed < 0.5 THEN 'still' WHEN speed < 2.5 THEN 'walking' ELSE 'driving' END AS motion,
    CASE WHEN level >= 0 THEN CAST(floor(least(1.0, level) * 100 + 0.5) AS BIGINT) END AS battery_pct FROM raw),
  t AS (SELECT *, CASE WHEN charging OR motion <> 'still' THEN 'active' WHEN battery_pct < 20 THEN 'saver' ELSE 'idle' END AS tier FROM m)
SELECT event_id, CASE WHEN heading >= 0 THEN fmod(heading, 360) END AS heading, motion, battery_pct, tier,
  CAST(CASE tier WHEN 'active' THEN 10000 WHEN 'idle' THEN 60000 ELSE 180000 END AS BIGINT) AS interval_ms,
  CAST(CASE tier WHEN 'active' THEN 20 WHEN 'idle' THEN 50 ELSE 100 END AS BIGINT) AS interval_m FROM t""",
    "zoom_levels": """WITH s AS (SELECT event_id, greatest((event_id % 1000) * 0.001::double, (event_id % 37) * 0.02::double) AS span FROM events)
SELECT event_id, CAST(CASE WHEN span <= 0 THEN 16 ELSE greatest(2, least(18, floor(log2(360.0::double / span)))) END AS BIGINT) AS zoom FROM s""",
    "dwell_labels": q(
        STOPS,
        "lab AS (SELECT *, CAST(floor(((departed_us - arrived_us) // 1000) / 60000.0::double + 0.5) AS BIGINT) AS mins FROM dstops)",
        "SELECT vehicle_id, arrived_us, CASE WHEN departed_us IS NULL THEN 'still here' WHEN mins < 1 THEN '<1 min' WHEN mins < 60 THEN mins || ' min' "
        "ELSE (mins // 60) || 'h ' || (mins % 60) || 'm' END AS dwell FROM lab",
    ),
    "tracking_health": q(
        VEHICLES,
        "st AS (SELECT id, CASE WHEN length(id) % 5 = 0 THEN 'off' WHEN id LIKE '%3' THEN 'blocked' WHEN last_reported_us IS NULL THEN 'awaiting-fix' ELSE 'running' END AS state FROM vlast)",
        "SELECT id, state, CASE state WHEN 'off' THEN 'stopped' WHEN 'blocked' THEN 'location off' WHEN 'awaiting-fix' THEN 'no fix yet' ELSE 'running' END AS label, "
        "state = 'running' AS healthy, state = 'blocked' AS needs_action FROM st",
    ),
    "fix_quality": q("SELECT vehicle_id, count(*) AS usable, count(*) FILTER (speed_mps IS NULL OR speed_mps <= 1) AS stationary FROM pos WHERE accuracy_m IS NULL OR accuracy_m <= 50 GROUP BY 1"),
    "reading_validation": q(JUDGED, "SELECT coalesce(reading_id, '00000000-0000-0000-0000-000000000000') AS id, reason FROM judged WHERE reason IS NOT NULL"),
    "readings_accepted": q(JUDGED, "SELECT vehicle_id, count(*) AS accepted FROM judged WHERE reason IS NULL GROUP BY 1"),
    "stop_validation": q(
        f"""f AS (SELECT event_id AS n, CASE WHEN event_id % 101 <> 0 THEN reading_id END AS id, CASE WHEN event_id % 103 <> 0 THEN us END AS arrived,
  CASE WHEN event_id % 107 = 0 THEN us - 1000000 WHEN event_id % 109 = 0 THEN us + {60 * HOUR} WHEN event_id % 2 = 0 THEN us + 300000000 END AS dep FROM pos),
j AS (SELECT *, CASE WHEN id IS NULL THEN 'event_id is required' WHEN arrived IS NULL THEN 'arrived_at is required'
  WHEN dep < arrived THEN 'departed_at is before arrived_at' WHEN dep > {SKEW_LIMIT} THEN 'departed_at is more than 24h0m0s in the future'
  WHEN n % 113 = 0 THEN 'lat NaN out of range [-90, 90]' WHEN n % 127 = 0 THEN 'lon 200 out of range [-180, 180]' END AS reason FROM f)""",
        "SELECT coalesce(id, '00000000-0000-0000-0000-000000000000') AS id, reason FROM j WHERE reason IS NOT NULL",
    ),
    "batch_validation": """WITH b AS (SELECT event_id, event_id % 19 = 0 AS anon, CASE WHEN event_id % 10 = 0 THEN event_id % 1300 ELSE event_id % 3 END AS r,
    CASE WHEN event_id % 9 = 0 THEN event_id % 260 ELSE event_id % 2 END AS s FROM events),
  j AS (SELECT event_id, CASE WHEN anon THEN 'device_id is required' WHEN r = 0 AND s = 0 THEN 'batch must contain readings or stop_events'
    WHEN r > 1000 THEN 'batch has ' || r || ' readings, limit is 1000' WHEN s > 200 THEN 'batch has ' || s || ' stop_events, limit is 200' END AS reason FROM b)
SELECT * FROM j WHERE reason IS NOT NULL""",
    "batch_building": q(
        CLIENT, QUEUED,
        "SELECT device_id, CAST(batch_no AS BIGINT) AS batch_no, count(*) FILTER (is_reading) AS n_readings, count(*) FILTER (NOT is_reading) AS n_stops, "
        "count(*) FILTER (no_speed) AS n_no_speed FROM numbered GROUP BY 1, 2",
    ),
    "telemetry_batches": q(READINGS),
    "telemetry_stops": q(CLIENT, "SELECT 'dev-' || vehicle_id AS device_id, arrived_us, departed_us, lat, lon FROM emitted"),
    "ingest_stream": q("SELECT reading_id, us AS recorded_us, lat, CAST(battery_pct AS BIGINT) AS battery_pct FROM pos"),
    "ingest_streams": q("SELECT reading_id, CAST(1 AS BIGINT) AS times, us AS recorded_us FROM pos"),
    "ingest_response": q(
        JUDGED, CLIENT,
        "SELECT 'dev-' || vehicle_id AS device_id, CAST(sum(r) AS BIGINT) AS accepted, CAST(sum(s) AS BIGINT) AS accepted_stops FROM ("
        "SELECT vehicle_id, 1 AS r, 0 AS s FROM judged WHERE reason IS NULL UNION ALL SELECT vehicle_id, 0, 1 FROM emitted) GROUP BY 1",
    ),
    "batch_answers": q(
        JUDGED,
        "SELECT vehicle_id, event_id // 1000 AS batch_no, CASE WHEN event_id // 1000 % 7 = 3 THEN 'device_id is required' END AS reason, "
        "CASE WHEN event_id // 1000 % 7 = 3 THEN 0 ELSE count(*) FILTER (reason IS NULL) END AS accepted, CAST(0 AS BIGINT) AS accepted_stops, "
        "CASE WHEN event_id // 1000 % 7 = 3 THEN '' ELSE coalesce(string_agg(coalesce(reading_id, '00000000-0000-0000-0000-000000000000') || ': ' || reason, '; ' "
        "ORDER BY event_id) FILTER (reason IS NOT NULL), '') END AS rejected FROM judged GROUP BY vehicle_id, event_id // 1000",
    ),
    "clock_offsets": q(
        "SELECT 'dev-' || vehicle_id AS device_id, count(*) AS batches, round(avg((received_us - us - 250000) // 1000), 3) AS mean_offset_ms "
        "FROM pos WHERE event_id % 5 <> 0 GROUP BY 1"
    ),
    "idempotent_load": q("SELECT reading_id, vehicle_id, round(lat, 6) AS lat FROM pos WHERE event_id % 3 <> 0"),
    "load_audit": q(
        "SELECT count(*) + count(*) FILTER (event_id % 2 = 0) AS enqueued, count(*) FILTER (event_id % 3 <> 0) AS inserted, "
        "count(*) + count(*) FILTER (event_id % 2 = 0) - count(*) FILTER (event_id % 3 <> 0) AS duplicates FROM pos"
    ),
    "stop_report_collapse": q(CLIENT, REPORTS, "SELECT vehicle_id, arrived_us, departed_us, round(lat, 6) AS lat FROM col"),
    "client_stop_merge": q(
        CLIENT, REPORTS,
        "SELECT s.vehicle_id, s.arrived_us, coalesce(s.departed_us, c.departed_us) AS departed_us, round(s.lat, 6) AS lat FROM snap s LEFT JOIN col c ON c.id = s.id "
        "UNION ALL SELECT vehicle_id, arrived_us, departed_us, round(lat, 6) FROM col WHERE id NOT IN (SELECT id FROM snap)",
    ),
    "client_stop_merge_effects": q(
        CLIENT, REPORTS,
        "SELECT 'inserted' AS change, count(*) AS stops FROM col WHERE id NOT IN (SELECT id FROM snap) UNION ALL "
        "SELECT 'closed', count(*) FROM snap s JOIN col c ON c.id = s.id WHERE c.departed_us IS NOT NULL",
    ),
    "client_stop_log": q(
        CLIENT, REPORTS,
        "SELECT vehicle_id, arrived_us, (SELECT max(departed_us) FROM rep r WHERE r.id = f.id) AS departed_us, round(lat, 6) AS lat "
        "FROM (SELECT * FROM rep QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1) f",
    ),
    "client_stop_state": q(
        CLIENT, REPORTS,
        "SELECT vehicle_id, arrived_us, (SELECT max(departed_us) FROM rep r WHERE r.id = f.id) AS departed_us, round(lat, 6) AS lat "
        "FROM (SELECT * FROM rep QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1) f",
    ),
    "derived_window_replace": q(
        STOPS, TRIPS, CLIENT, ALL, REPLACED,
        f"""SELECT 'trip' AS what, vehicle_id, 'derived' AS source, started_us AS from_us, ended_us AS to_us FROM dtrips
  WHERE NOT ({overlap('started_us', 'ended_us')} AND vehicle_id IN (SELECT vehicle_id FROM act_v))
UNION ALL SELECT 'trip', vehicle_id, 'derived', started_us, ended_us FROM ntrips
UNION ALL SELECT 'stop', vehicle_id, source, arrived_us, departed_us FROM alls
  WHERE NOT (source = 'derived' AND {overlap('arrived_us', 'departed_us')} AND vehicle_id IN (SELECT vehicle_id FROM act_v))
UNION ALL SELECT 'stop', vehicle_id, 'derived', arrived_us, departed_us FROM nstops""",
    ),
    "match_window_replace": q(
        STOPS, CLIENT, MATCHED,
        f"cin AS (SELECT * FROM cstops WHERE arrived_us >= {FROM} AND arrived_us < {TO})",
        match_cte("rematch", "cin", "dstops", 1),
        f"SELECT client_event_id, derived_event_id, delta_seconds FROM matched WHERE client_us < {FROM} OR client_us >= {TO} "
        "UNION ALL SELECT client_event_id, derived_event_id, delta_seconds FROM rematch",
    ),
    "orphan_matches": q(STOPS, CLIENT, MATCHED, "SELECT client_event_id, derived_event_id FROM matched WHERE derived_us % 3 <> 0"),
    "vehicle_registration": q(
        VEHICLES,
        f"SELECT CASE WHEN id LIKE '%1' THEN sha256('vehicle|' || external_id) ELSE id END AS id, external_id, "
        f"CASE WHEN id LIKE '%1' THEN external_id ELSE label END AS label, CASE WHEN id LIKE '%1' THEN {NOW} ELSE {EPOCH_US} END AS created_us "
        "FROM veh WHERE NOT (id LIKE 'silent-%' AND id LIKE '%1')",
    ),
    "local_retention": q(
        f"SELECT 'kept' AS what, count(*) AS positions FROM pos WHERE us >= {FROM} UNION ALL SELECT 'dropped', count(*) FROM pos WHERE us < {FROM}"
    ),
    "constraint_report": q(
        STOPS, TRIPS, CLIENT, ALL, FLAWED, LINKED,
        """t AS (SELECT *, started_us % 10 AS odd FROM dtrips)""",
        """SELECT "table", rule, count(*) AS rows FROM (
  SELECT 'positions' AS "table", unnest([CASE WHEN lat > 90 OR lat < -90 OR isnan(lat) THEN 'lat_range' END, CASE WHEN lon < -180 THEN 'lon_range' END,
    CASE WHEN battery_pct > 100 THEN 'battery_range' END, CASE WHEN heading_deg > 360 THEN 'heading_range' END,
    CASE WHEN motion_state = 'flying' THEN 'motion_state' END, CASE WHEN event_id % 151 = 0 AND reading_id IS NOT NULL THEN 'vehicle_exists' END]) AS rule
    FROM (SELECT * FROM flaw)
  UNION ALL SELECT 'trips', unnest([CASE WHEN odd = 1 THEN 'source' END, CASE WHEN odd = 2 THEN 'ended_after_started' END, CASE WHEN odd = 3 THEN 'distance_non_negative' END]) FROM t
  UNION ALL SELECT 'stop_events', 'departed_after_arrived' FROM alls WHERE arrived_us % 10 = 1
  UNION ALL SELECT 'stop_event_matches', 'distinct_events' FROM cstops) WHERE rule IS NOT NULL GROUP BY ALL""",
    ),
    "broken_references": q(
        STOPS, TRIPS,
        """SELECT "table", rule, count(*) AS rows FROM (
  SELECT 'trips' AS "table", 'vehicle_exists' AS rule FROM dtrips WHERE started_us % 5 = 0
  UNION ALL SELECT 'stop_events', CASE arrived_us % 10 WHEN 0 THEN 'vehicle_exists' WHEN 1 THEN 'trip_exists' WHEN 2 THEN 'lat_range'
    WHEN 3 THEN 'lon_range' WHEN 4 THEN 'source' END FROM dstops WHERE arrived_us % 10 < 5
  UNION ALL SELECT 'stop_event_matches', CASE arrived_us % 10 WHEN 5 THEN 'client_exists' ELSE 'derived_exists' END
    FROM dstops WHERE arrived_us % 10 IN (5, 6)) GROUP BY ALL""",
    ),
    "open_trip_check": q(STOPS, TRIPS, "SELECT vehicle_id, 'derived' AS source, count(*) AS open_trips FROM dtrips WHERE started_us % 4 = 0 GROUP BY 1 HAVING count(*) > 1"),
    "sampling_backtest": q(
        """tl AS (SELECT vehicle_id, us, CASE WHEN coalesce(motion_state, '') <> 'still' THEN 'active' WHEN battery_pct < 20 THEN 'saver' ELSE 'idle' END AS want,
         row_number() OVER (PARTITION BY vehicle_id ORDER BY us, reading_id) AS k FROM pos),
tw AS (SELECT DISTINCT vehicle_id, 0::BIGINT AS k, 0::BIGINT AS us, 'active' AS tier, NULL::VARCHAR AS pend, NULL::BIGINT AS pend_us, false AS changed FROM tl
  UNION ALL
  SELECT vehicle_id, k, us, CASE WHEN adopt THEN want ELSE tier END,
    CASE WHEN want = tier OR adopt THEN NULL ELSE want END,
    CASE WHEN want = tier OR adopt THEN NULL WHEN pend = want THEN pend_us ELSE us END, adopt
  FROM (SELECT w.vehicle_id, t.k, t.us, t.want, w.tier, w.pend, w.pend_us,
          want <> tier AND (want = 'active' OR coalesce(pend = want AND t.us - pend_us >= 120000000, false)) AS adopt
        FROM tw w JOIN tl t ON t.vehicle_id = w.vehicle_id AND t.k = w.k + 1))""",
        "SELECT vehicle_id, us AS changed_us, tier FROM tw WHERE changed",
    ),
    "battery_drain": drain_sql("SELECT * FROM pos", False),
    "battery_drain_stationary": drain_sql(
        "SELECT * REPLACE (CASE WHEN user_id % 2 = 0 THEN 'still' ELSE motion_state END AS motion_state) FROM pos", True
    ),
    "ack_translation": q(QUEUE, "SELECT batch_id, id, named AS verdict FROM ack"),
    "delivery_plan": q(QUEUE, "SELECT id, outcome, verdict, action, error FROM act"),
    "ledger_update": q(
        QUEUE,
        "SELECT id, CAST(CASE WHEN action = 'fail' THEN attempts + 1 ELSE attempts END AS BIGINT) AS attempts, CASE WHEN action = 'fail' THEN error END AS last_error "
        "FROM act WHERE action NOT IN ('remove', 'quarantine')",
    ),
    "quarantine_split": q(QUEUE, f"SELECT id, CAST(attempts AS BIGINT) AS attempts, error AS reason, {NOW} AS quarantined_us FROM act WHERE action = 'quarantine'"),
    "drain_counts": q(
        QUEUE,
        "SELECT device_id, count(*) AS sent, count(*) FILTER (verdict = 'accepted') AS accepted, count(*) FILTER (verdict = 'rejected') AS rejected, "
        "count(*) FILTER (action = 'quarantine') AS quarantined, CAST(0 AS BIGINT) AS dropped, count(*) FILTER (action NOT IN ('remove', 'quarantine')) AS remaining FROM act GROUP BY 1",
    ),
    "queue_insert": q(QUEUE, "SELECT id, CAST(CASE WHEN n % 2 = 0 THEN attempts ELSE 0 END AS BIGINT) AS attempts FROM que"),
    "queue_peek": q(QUEUE, "SELECT device_id, row_number() OVER (PARTITION BY device_id ORDER BY created_us, id) AS position, id FROM que QUALIFY position <= 10"),
    "queue_trim": q(QUEUE, "SELECT device_id, id FROM que QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY created_us DESC, id DESC) <= 40"),
    "queue_dropped": q(QUEUE, "SELECT device_id, greatest(count(*) - 40, 0) AS dropped FROM que GROUP BY 1"),
    "dead_items": q(QUEUE, "SELECT device_id, row_number() OVER (PARTITION BY device_id ORDER BY n % 1000 DESC, id) AS position, id FROM que QUALIFY position <= 5"),
}

# The same answers when the busiest vehicles are cut into slices, and when rows come late.
for _cut, _whole in {
    "cut_stop_detection": "stop_detection", "cut_trip_detection": "trip_detection", "cut_parked_samples": "parked_samples",
    "cut_client_detection": "client_stop_detection", "cut_sampling_backtest": "sampling_backtest", "cut_route_thinning": "route_thinning",
    "late_rows": "trip_detection",
}.items():
    ORACLE[_cut] = ORACLE[_whole]
