"""SQL twins of the registered queries, for DuckDB on the raw star-schema tables.

Every statement starts with the same definitions of the domain tables and request
batches; an engine evaluates only the ones a query uses.
"""

from __future__ import annotations

from fareline.functions import fixed_values as V
from fareline.plans.catalog import AS_OF, JOURNEY_DATE, STATUS
from fareline.sources.schemas import TABLES

_TABLES = """
WITH RECURSIVE n AS (SELECT (SELECT count(*) FROM part) AS n_route, (SELECT count(*) FROM supplier) AS n_bus,
  (SELECT count(*) FROM orders) AS n_order),
users AS (
  SELECT c_custkey AS user_id, c_name AS username, c_mktsegment AS first_name,
    concat('N', CAST(c_nationkey AS VARCHAR)) AS last_name,
    concat(lower(replace(c_name, '#', '.')), '@example.com') AS email,
    CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN '' WHEN c_custkey % 5 = 2 THEN '0'
      ELSE concat('01', lpad(CAST(c_custkey AS VARCHAR), 9, '0')) END AS phone_number,
    CASE WHEN c_custkey % 4 <> 0 THEN concat('Street ', CAST(c_custkey % 97 AS VARCHAR)) END AS address,
    CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS is_admin,
    CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS is_active,
    DATE '2020-01-01' + CAST(c_custkey % 1000 AS INT) AS created_at
  FROM customer),
buses AS (
  SELECT s_suppkey AS bus_id, s_name AS bus_number,
    concat('Model-', CAST(s_nationkey % 4 AS VARCHAR)) AS bus_model,
    concat('LP-', CAST(s_suppkey AS VARCHAR)) AS license_plate,
    CAST(10 + s_suppkey % 51 AS INT) AS capacity,
    CASE WHEN s_acctbal >= 0 THEN 1 ELSE 0 END AS is_active,
    DATE '2020-01-01' + CAST(s_suppkey % 500 AS INT) AS created_at
  FROM supplier),
seats AS (
  SELECT CAST(bus_id * 100 + i AS BIGINT) AS seat_id, bus_id, concat('A', CAST(i AS VARCHAR)) AS seat_number
  FROM (SELECT bus_id, unnest(range(1, CASE WHEN bus_id % 20 = 3 THEN capacity - 2 ELSE capacity END + 1)) AS i
    FROM buses)),
routes AS (
  SELECT p_partkey AS route_id, concat(p_name, ' #', CAST(p_partkey AS VARCHAR)) AS route_name,
    CASE WHEN p_partkey % 31 = 0 THEN lower(o.n_name) WHEN p_partkey % 37 = 0 THEN replace(o.n_name, 'A', 'Á')
      ELSE o.n_name END AS origin_city, d.n_name AS destination_city, p_size * 10 AS distance,
    CAST(p_retailprice AS DECIMAL(10,2)) AS fare,
    CASE WHEN p_size % 7 = 0 THEN NULL
      ELSE concat(lpad(CAST(1 + p_size % 12 AS VARCHAR), 2, '0'), ':30:00') END AS travel_time,
    concat(lpad(CAST((p_partkey * 37) % 24 AS VARCHAR), 2, '0'), ':',
      lpad(CAST((p_partkey * 5) % 60 AS VARCHAR), 2, '0'), ':00') AS departure_time,
    CASE WHEN p_size > 5 THEN 1 ELSE 0 END AS is_active,
    DATE '2020-01-01' + CAST(p_partkey % 700 AS INT) AS created_at
  FROM part JOIN nation o ON o.n_nationkey = p_partkey % 25
    JOIN nation d ON d.n_nationkey = (p_partkey + 1 + p_size % 24) % 25),
bus_route AS (
  SELECT route_id % n_bus AS bus_id, route_id FROM routes, n
  UNION
  SELECT (route_id + 1) % n_bus, route_id FROM routes, n WHERE route_id % 10 <> 0),
drawn AS (
  SELECT orders.*, n_bus, CASE WHEN r % 40 = 7 THEN (r + 1) % n_route ELSE r END AS route_id,
    CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'pending' ELSE 'cancelled' END AS status
  FROM (SELECT o_orderkey AS k, (o_orderkey * 13 + o_custkey) % n_route AS r FROM orders, n) x
    JOIN orders ON o_orderkey = k, n),
trip AS (
  SELECT o_orderkey AS booking_id, o_custkey AS user_id, route_id,
    CASE WHEN (route_id + o_orderkey % 2) % n_bus % 10 = 9 THEN ((route_id + o_orderkey % 2) % n_bus + 1) % n_bus
      ELSE (route_id + o_orderkey % 2) % n_bus END AS bus_id,
    CAST(o_orderdate AS DATE) AS booking_date,
    DATE '2024-01-01' + CAST(o_orderkey % 7 AS INT) AS journey_date,
    CASE WHEN o_orderkey % 29 = 0 THEN upper(status) ELSE status END AS status, o_orderpriority
  FROM drawn),
booking_seat AS (
  SELECT DISTINCT t.booking_id, t.bus_id * 100 + 1 + (l_orderkey * 7 + l_linenumber * 3) % b.capacity AS seat_id
  FROM lineitem JOIN trip t ON l_orderkey = t.booking_id JOIN buses b ON b.bus_id = t.bus_id),
bookings AS (
  SELECT t.booking_id, t.user_id, t.route_id, t.bus_id, t.booking_date, t.journey_date, t.status,
    n.seat_count, n.seat_count AS total_passengers,
    CAST((r.fare - CASE WHEN t.booking_id % 17 = 0 THEN 10 ELSE 0 END) * n.seat_count AS DECIMAL(12,2)) AS total_amount,
    t.booking_date AS created_at,
    CASE WHEN t.booking_id % 3 = 0 THEN NULL
      ELSE concat('Pax ', CAST(t.booking_id AS VARCHAR), chr(10), 'Guest') END AS passenger_names,
    CASE WHEN t.booking_id % 3 = 1 THEN '01700000000, 01800000000' END AS passenger_phones
  FROM trip t
    JOIN (SELECT booking_id, CAST(count(*) AS INT) AS seat_count FROM booking_seat GROUP BY booking_id) n
      ON n.booking_id = t.booking_id
    JOIN routes r ON r.route_id = t.route_id),
payments AS (
  SELECT b.booking_id * 2 + k.k AS payment_id, b.booking_id, b.user_id, b.total_amount AS amount,
    CASE t.o_orderpriority WHEN '1-URGENT' THEN 'bKash' WHEN '2-HIGH' THEN 'Nagad'
      WHEN '3-MEDIUM' THEN 'Credit Card' WHEN '4-NOT SPECIFIED' THEN 'Cash' ELSE 'bKash' END AS payment_method,
    concat('TXN', lpad(CAST(b.booking_id * 2 + k.k AS VARCHAR), 14, '0')) AS transaction_id,
    'completed' AS payment_status
  FROM bookings b JOIN trip t ON t.booking_id = b.booking_id
    JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) k ON k.k = 0 OR b.booking_id % 23 = 0
  WHERE (lower(b.status) = 'confirmed' AND b.booking_id % 11 <> 0)
    OR (lower(b.status) = 'cancelled' AND b.booking_id % 4 = 0)),
trips AS (SELECT DISTINCT bus_id, route_id, journey_date FROM bookings),
holds AS (
  SELECT bs.seat_id, b.route_id, b.journey_date, b.booking_id
  FROM booking_seat bs JOIN bookings b ON b.booking_id = bs.booking_id WHERE lower(b.status) <> 'cancelled'),
booking_changes AS (
  SELECT event_id AS change_id, ts, (event_id * 7) % n_order AS booking_id,
    CASE event_type WHEN 'purchase' THEN 'pay' ELSE 'set_status' END AS kind,
    CASE event_type WHEN 'click' THEN 'pending' WHEN 'signup' THEN 'confirmed' WHEN 'error' THEN 'cancelled'
      ELSE 'confirmed' END AS new_status,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'bKash' ELSE 'Nagad' END END AS payment_method,
    user_id
  FROM events, n WHERE event_type <> 'view'),
change_log AS (
  SELECT c.change_id, c.ts, c.booking_id, c.kind, c.new_status, c.payment_method,
    CASE WHEN c.change_id % 4 = 0 THEN c.user_id ELSE coalesce(b.user_id, c.user_id) END AS user_id
  FROM booking_changes c LEFT JOIN bookings b ON b.booking_id = c.booking_id),
pay_requests AS (SELECT * FROM change_log WHERE kind = 'pay'),
accepted_pays AS (
  SELECT p.*, b.total_amount FROM pay_requests p JOIN bookings b
    ON b.booking_id = p.booking_id AND b.user_id = p.user_id),
effective AS (
  SELECT c.booking_id, c.ts, c.change_id,
    CASE WHEN c.kind = 'pay' THEN 'confirmed' ELSE c.new_status END AS new_status
  FROM change_log c JOIN bookings b ON b.booking_id = c.booking_id
  WHERE c.kind <> 'pay' OR c.user_id = b.user_id),
booking_requests AS (
  SELECT event_id AS request_id, ts, user_id, event_id % n_route AS route_id,
    (event_id % n_route) % n_bus AS bus_id, CAST(ts AS DATE) AS journey_date,
    CAST(event_id % 4 AS INT) AS n_seats, CAST(event_id % 6 AS INT) AS first_seat, props
  FROM events, n WHERE event_type IN ('purchase', 'view')),
accepted_requests AS (
  SELECT q.*, r.fare, (SELECT max(booking_id) FROM bookings) + 1 + q.request_id AS booking_id
  FROM booking_requests q JOIN routes r ON r.route_id = q.route_id AND r.is_active = 1
  WHERE q.n_seats > 0),
-- One by one in order of arrival on each route and day: a request gets in if all its seats are free.
requests_in_turn AS (
  SELECT *, list_transform(range(0, n_seats), lambda i: bus_id * 100 + 1 + first_seat + i) AS seats,
    row_number() OVER (PARTITION BY route_id, journey_date ORDER BY ts, request_id) AS turn
  FROM accepted_requests),
seat_fold AS (
  SELECT q.route_id, q.journey_date, CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS request_id, false AS fits,
    coalesce((SELECT list(h.seat_id) FROM holds h WHERE h.route_id = q.route_id AND h.journey_date = q.journey_date),
      CAST([] AS BIGINT[])) AS taken
  FROM (SELECT DISTINCT route_id, journey_date FROM requests_in_turn) q
  UNION ALL
  SELECT i.route_id, i.journey_date, i.turn, i.request_id, NOT list_has_any(f.taken, i.seats),
    CASE WHEN list_has_any(f.taken, i.seats) THEN f.taken ELSE list_concat(f.taken, i.seats) END
  FROM seat_fold f JOIN requests_in_turn i
    ON i.route_id = f.route_id AND i.journey_date = f.journey_date AND i.turn = f.turn + 1),
seated_requests AS (SELECT q.* FROM accepted_requests q JOIN seat_fold f ON f.request_id = q.request_id AND f.fits),
registrations AS (
  SELECT event_id AS reg_id, ts,
    CASE WHEN event_id % 3 = 0 THEN concat('Customer#', lpad(CAST(user_id AS VARCHAR), 9, '0'))
      WHEN event_id % 3 = 1 THEN concat(CASE WHEN event_id // 50 % 2 = 0 THEN 'new' ELSE 'NÉW' END, CAST(event_id % 50 AS VARCHAR))
      ELSE concat('u', CAST(event_id // 2 AS VARCHAR)) END AS username,
    CASE WHEN event_id % 10 = 0 THEN '0' ELSE 'First' END AS first_name,
    CASE WHEN event_id % 13 = 0 THEN '' ELSE 'Last' END AS last_name,
    CASE WHEN event_id % 8 = 0 THEN concat('customer.', lpad(CAST(user_id AS VARCHAR), 9, '0'), '@example.com')
      ELSE concat('E', CAST(event_id % 701 AS VARCHAR), '@example.com') END AS email,
    CASE WHEN event_id % 7 <> 0 THEN concat('01', CAST(event_id AS VARCHAR)) ELSE '' END AS phone_number,
    CASE WHEN event_id % 5 <> 0 THEN concat('Street', CAST(event_id % 97 AS VARCHAR)) ELSE '' END AS address
  FROM events WHERE event_type = 'signup'),
checked_regs AS (
  SELECT r.*, (first_name IN ('', '0') OR last_name IN ('', '0')) AS incomplete,
    EXISTS (SELECT 1 FROM users u WHERE strip_accents(lower(u.username)) = strip_accents(lower(r.username))) AS name_known,
    EXISTS (SELECT 1 FROM users u WHERE strip_accents(lower(u.email)) = strip_accents(lower(r.email))) AS mail_known
  FROM registrations r),
-- One by one in order of arrival: a sign-up gets in if no admitted one has its name or address.
in_turn AS (
  SELECT *, strip_accents(lower(username)) AS name, strip_accents(lower(email)) AS mail,
    row_number() OVER (ORDER BY ts, reg_id) AS turn FROM checked_regs
  WHERE NOT incomplete AND NOT name_known AND NOT mail_known),
fold AS (
  SELECT CAST(0 AS BIGINT) AS turn, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS mails, false AS fits
  UNION ALL
  SELECT turn, CASE WHEN fits THEN list_append(names, name) ELSE names END,
    CASE WHEN fits THEN list_append(mails, mail) ELSE mails END, fits
  FROM (
    SELECT i.turn, f.names, f.mails, i.name, i.mail, NOT list_contains(f.names, i.name) AND NOT list_contains(f.mails, i.mail) AS fits
    FROM fold f JOIN in_turn i ON i.turn = f.turn + 1)),
admitted_regs AS (
  SELECT i.* FROM in_turn i JOIN fold f ON f.turn = i.turn WHERE f.fits),
judged_regs AS (
  SELECT c.*, (c.name_known OR EXISTS (SELECT 1 FROM admitted_regs a
      WHERE a.name = strip_accents(lower(c.username)) AND (a.ts, a.reg_id) < (c.ts, c.reg_id))) AS name_taken,
    (c.mail_known OR EXISTS (SELECT 1 FROM admitted_regs a
      WHERE a.mail = strip_accents(lower(c.email)) AND (a.ts, a.reg_id) < (c.ts, c.reg_id))) AS mail_taken
  FROM checked_regs c),
route_edits AS (
  SELECT event_id, event_id % n_route AS route_id, CAST(CAST(value AS DECIMAL(10,2)) + 25 AS DECIMAL(10,2)) AS fare,
    CASE WHEN event_id % 18 <> 0 THEN 1 ELSE 0 END AS is_active, (event_id + 2) % n_bus AS bus_id
  FROM events, n WHERE event_type = 'click' AND event_id % 43 <> 0 AND event_id % 41 <> 0
  QUALIFY row_number() OVER (PARTITION BY event_id % n_route ORDER BY ts DESC, event_id DESC) = 1),
bus_edits AS (
  SELECT event_id % n_bus AS bus_id,
    arg_max(event_id, (ts, event_id)) AS last_id, arg_max(value, (ts, event_id)) AS last_value
  FROM events, n WHERE event_type = 'error' AND event_id % 19 <> 0 GROUP BY 1),
new_buses AS (
  SELECT s_suppkey AS request_id, concat(s_name, '-N') AS bus_number, concat('LP-N', CAST(s_suppkey AS VARCHAR)) AS license_plate,
    CASE WHEN s_suppkey % 25 = 0 THEN 0 ELSE CAST(10 + s_suppkey % 51 AS INT) END AS capacity
  FROM supplier WHERE s_suppkey % 25 = 0 OR s_suppkey % 7 <> 3),
new_routes AS (
  SELECT p_partkey AS request_id, (SELECT max(route_id) FROM routes) + 1 + p_partkey AS route_id,
    concat(p_name, ' &quot;season&quot;') AS route_name, concat('From ', p_brand) AS origin_city,
    concat('To ', p_brand) AS destination_city, p_size * 10 AS distance,
    CAST(p_size + 0.75 AS DECIMAL(10,2)) AS fare, p_size
  FROM part WHERE p_partkey % 33 <> 5),
seat_map AS (
  SELECT t.bus_id, t.route_id, t.journey_date, s.seat_id, s.seat_number, h.seat_id IS NOT NULL AS is_booked
  FROM trips t JOIN seats s ON s.bus_id = t.bus_id
    LEFT JOIN (SELECT DISTINCT seat_id, route_id, journey_date FROM holds) h
      ON h.seat_id = s.seat_id AND h.route_id = t.route_id AND h.journey_date = t.journey_date),
seat_names AS (
  SELECT bs.booking_id, string_agg(s.seat_number, ', ' ORDER BY s.seat_id) AS seat_numbers
  FROM booking_seat bs JOIN seats s ON s.seat_id = bs.seat_id GROUP BY bs.booking_id),
booking_list AS (
  SELECT b.*, u.username, u.email, r.route_name, r.origin_city, r.destination_city, bus.bus_number,
    p.payment_status, p.payment_method, p.amount AS payment_amount
  FROM bookings b JOIN users u ON u.user_id = b.user_id JOIN routes r ON r.route_id = b.route_id
    JOIN buses bus ON bus.bus_id = b.bus_id LEFT JOIN payments p ON p.booking_id = b.booking_id),
searches AS (
  SELECT event_id AS search_id,
    CASE event_id % 6 WHEN 1 THEN concat('nation_', CAST(event_id % 25 AS VARCHAR))
      WHEN 2 THEN concat('n%', CAST(event_id % 10 AS VARCHAR)) WHEN 3 THEN concat('ation_', CAST(event_id % 3 AS VARCHAR))
      WHEN 5 THEN concat('on\\_', CAST(event_id % 7 AS VARCHAR)) ELSE '' END AS origin,
    CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('_', CAST(event_id % 10 AS VARCHAR)) WHEN 2 THEN 'o'
      WHEN 3 THEN 'nowhere' ELSE concat('ion__', CAST(event_id % 4 AS VARCHAR)) END AS destination
  FROM events WHERE event_type = 'view'),
found AS (
  SELECT i.*, r.* FROM (SELECT origin, destination, count(*) AS n_searches FROM searches GROUP BY ALL) i JOIN routes r
    ON r.is_active = 1 AND (i.origin = '' OR strip_accents(lower(r.origin_city)) LIKE concat('%', i.origin, '%') ESCAPE '\\')
      AND (i.destination = '' OR strip_accents(lower(r.destination_city)) LIKE concat('%', i.destination, '%') ESCAPE '\\')),
searched AS (
  SELECT * FROM routes WHERE is_active = 1 AND strip_accents(origin_city) ILIKE '%nation_1%'
    AND strip_accents(destination_city) ILIKE '%N_2%'),
with_buses AS (
  SELECT r.*, (SELECT count(*) FROM bus_route br WHERE br.route_id = r.route_id) AS available_buses
  FROM routes r WHERE is_active = 1)
"""

_BOOKING = (
    "b.booking_id, b.user_id, b.route_id, b.bus_id, b.booking_date, b.journey_date, b.status, b.seat_count,"
    " b.total_passengers, b.total_amount, b.passenger_names, b.passenger_phones"
)
_ROUTE = (
    "r.route_name, r.origin_city, r.destination_city, r.distance, r.fare, r.travel_time, r.departure_time,"
    " r.is_active, r.created_at AS route_created_at"
)


def _totals(name: str, columns: list[str]) -> str:
    row = ", '|', ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in columns)
    return (
        f"SELECT '{name}' AS table_name, count(*) AS n_rows,"
        f" CAST(sum(CAST(concat('0x', substr(md5(concat({row})), 1, 8)) AS BIGINT)) AS BIGINT) AS row_sum FROM {name}"
    )


_TOTALS = " UNION ALL ".join(_totals(name, schema.names) for name, schema in TABLES.items())


def _with_status(source: str) -> str:
    return f"""
      SELECT b.* EXCLUDE (status), CASE WHEN c.booking_id IS NULL THEN b.status ELSE c.new_status END AS status
      FROM bookings b LEFT JOIN (SELECT booking_id, arg_max(new_status, (ts, change_id)) AS new_status
        FROM {source} GROUP BY booking_id) c ON c.booking_id = b.booking_id"""


def _with_requests(accepted: str) -> str:
    return f"""
      SELECT * FROM bookings UNION ALL
      SELECT booking_id, user_id, route_id, bus_id, DATE '{AS_OF}', journey_date, 'pending', n_seats, n_seats,
        CAST(fare * n_seats AS DECIMAL(12,2)), DATE '{AS_OF}',
        concat('Pax ', replace(props, '"', '&quot;'), chr(10), 'Guest'), '01700000000'
      FROM {accepted}"""


def _with_request_seats(accepted: str) -> str:
    return f"""
      SELECT * FROM booking_seat UNION ALL
      SELECT booking_id, bus_id * 100 + 1 + first_seat + i
      FROM (SELECT *, unnest(range(0, n_seats)) AS i FROM {accepted})"""


def _grouped(expression: str) -> str:
    return f"format('{{:,.2f}}', CAST(round({expression}, 2) AS DOUBLE))"


_QUERIES: dict[str, str] = {
    "i1_load_tables": _TOTALS,
    "i4_snapshot": _TOTALS,
    "i2_domain_tables": "SELECT * FROM bookings",
    "i2_payments": "SELECT * FROM payments",
    "a1_seat_map": "SELECT * FROM seat_map",
    "a1_seat_map_requested": """
      SELECT t.bus_id, t.route_id, t.journey_date, s.seat_id, s.seat_number, EXISTS (
        SELECT 1 FROM holds h WHERE h.seat_id = s.seat_id AND h.route_id = t.route_id
          AND h.journey_date = t.journey_date) AS is_booked
      FROM (SELECT DISTINCT bus_id, route_id, journey_date FROM booking_requests) t
        JOIN seats s ON s.bus_id = t.bus_id""",
    "a2_trip_occupancy": """
      SELECT bus_id, route_id, journey_date, count(*) AS total_seats,
        count(*) FILTER (is_booked) AS booked_seats, count(*) FILTER (NOT is_booked) AS free_seats
      FROM seat_map GROUP BY ALL""",
    "i3_seat_map_json": """
      SELECT bus_id, route_id, journey_date,
        concat('[', string_agg(concat('{"seat_id":', CAST(seat_id AS VARCHAR), ',"seat_number":"', seat_number,
          '","is_booked":', CASE WHEN is_booked THEN 'true' ELSE 'false' END, '}'), ','
          ORDER BY seat_number, seat_id), ']') AS seats_json
      FROM seat_map GROUP BY ALL""",
    "p1_active_routes": "SELECT * FROM routes WHERE is_active = 1",
    "p1_active_routes_requested": """
      SELECT * FROM routes WHERE is_active = 1 AND route_id IN (SELECT route_id FROM booking_requests)""",
    "p2_active_buses": "SELECT * FROM buses WHERE is_active = 1",
    "p3_search_routes": """
      SELECT s.*, (SELECT count(*) FROM bus_route br WHERE br.route_id = s.route_id) AS available_buses
      FROM searched s ORDER BY departure_time, route_id""",
    "p3_search_routes_open": "SELECT * FROM with_buses ORDER BY departure_time, route_id",
    "p3_search_batch": """
      SELECT f.*, (SELECT count(*) FROM bus_route br WHERE br.route_id = f.route_id) AS available_buses FROM found f""",
    "p3_search_batch_counts": """
      SELECT s.search_id, coalesce(c.n, 0) AS routes_found FROM searches s LEFT JOIN (
        SELECT origin, destination, count(*) AS n FROM found GROUP BY ALL) c
        ON c.origin = s.origin AND c.destination = s.destination""",
    "p4_filter_bookings": f"""
      SELECT * FROM bookings WHERE lower(status) = '{STATUS}' AND journey_date = DATE '{JOURNEY_DATE}'""",
    "p5_lookup": "SELECT * FROM buses WHERE bus_id IN (SELECT bus_id FROM bookings)",
    "p5_lookup_routes": "SELECT * FROM routes WHERE route_id IN (SELECT route_id FROM bookings)",
    "p6_passengers": "SELECT * FROM users WHERE is_admin = 0",
    "p7_assigned_buses": """
      SELECT route_id, string_agg(CAST(bus_id AS VARCHAR), ',' ORDER BY bus_id) AS bus_ids
      FROM bus_route GROUP BY route_id""",
    "p7_assignment_flags": """
      SELECT t.*, EXISTS (SELECT 1 FROM bus_route br WHERE br.bus_id = t.bus_id AND br.route_id = t.route_id)
        AS is_assigned
      FROM trips t""",
    "p8_owned_bookings": """
      SELECT * FROM bookings b WHERE EXISTS (SELECT 1 FROM pay_requests p
        WHERE p.booking_id = b.booking_id AND p.user_id = b.user_id)""",
    "j1_booking_list": "SELECT * FROM booking_list",
    "j1_booking_list_filtered": f"""
      SELECT * FROM booking_list WHERE lower(status) = '{STATUS}' AND journey_date = DATE '{JOURNEY_DATE}'""",
    "j2_user_bookings": """
      SELECT b.*, r.route_name, r.origin_city, r.destination_city, r.departure_time, bus.bus_number, bus.bus_model,
        p.payment_status, p.payment_method, p.transaction_id
      FROM bookings b JOIN routes r ON r.route_id = b.route_id JOIN buses bus ON bus.bus_id = b.bus_id
        LEFT JOIN payments p ON p.booking_id = b.booking_id""",
    "j3_detail_admin": f"""
      SELECT {_BOOKING}, b.created_at AS booking_created_at, u.username, u.email, u.phone_number, {_ROUTE},
        bus.bus_number, bus.bus_model, coalesce(s.seat_numbers, '') AS seat_numbers
      FROM bookings b JOIN users u ON u.user_id = b.user_id JOIN routes r ON r.route_id = b.route_id
        JOIN buses bus ON bus.bus_id = b.bus_id LEFT JOIN seat_names s ON s.booking_id = b.booking_id""",
    "j4_detail_user": f"""
      SELECT {_BOOKING}, b.created_at AS booking_created_at, {_ROUTE}, bus.bus_number, bus.bus_model,
        p.payment_status, p.payment_method, p.transaction_id, coalesce(s.seat_numbers, '') AS seat_numbers
      FROM bookings b JOIN routes r ON r.route_id = b.route_id JOIN buses bus ON bus.bus_id = b.bus_id
        LEFT JOIN (SELECT * FROM payments QUALIFY row_number() OVER (PARTITION BY booking_id ORDER BY payment_id) = 1) p
          ON p.booking_id = b.booking_id
        LEFT JOIN seat_names s ON s.booking_id = b.booking_id""",
    "j5_seat_numbers": "SELECT * FROM seat_names",
    "j6_checkout": f"""
      SELECT {_BOOKING}, b.created_at, r.route_name, r.origin_city, r.destination_city, r.departure_time,
        bus.bus_number, bus.bus_model, coalesce(s.seat_numbers, '') AS seat_numbers
      FROM bookings b JOIN routes r ON r.route_id = b.route_id JOIN buses bus ON bus.bus_id = b.bus_id
        LEFT JOIN seat_names s ON s.booking_id = b.booking_id""",
    "j7_route_buses": """
      SELECT br.route_id, b.* FROM bus_route br JOIN buses b ON b.bus_id = br.bus_id WHERE b.is_active = 1""",
    "g1_kpis": """
      SELECT (SELECT count(*) FROM users WHERE is_admin = 0) AS total_users,
        (SELECT count(*) FROM buses) AS total_buses, (SELECT count(*) FROM routes) AS total_routes,
        (SELECT count(*) FROM bookings) AS total_bookings,
        (SELECT count(*) FROM bookings WHERE lower(status) = 'pending') AS pending_bookings,
        (SELECT count(*) FROM bookings WHERE lower(status) = 'confirmed') AS confirmed_bookings,
        (SELECT CAST(coalesce(sum(amount), 0) AS DECIMAL(18,2)) FROM payments) AS total_revenue""",
    "g2_user_stats": """
      SELECT u.*, (SELECT count(*) FROM bookings b WHERE b.user_id = u.user_id) AS total_bookings,
        (SELECT count(*) FROM bookings b WHERE b.user_id = u.user_id AND lower(b.status) = 'confirmed') AS confirmed_bookings,
        CAST((SELECT coalesce(sum(total_amount), 0) FROM bookings b WHERE b.user_id = u.user_id) AS DECIMAL(18,2))
          AS total_spent
      FROM users u WHERE is_admin = 0 ORDER BY created_at DESC, user_id DESC""",
    "g3_user_counters": """
      SELECT (SELECT count(*) FROM users WHERE is_admin = 0) AS shown_users,
        (SELECT count(*) FROM users WHERE is_admin = 0 AND is_active = 1) AS active_users,
        (SELECT count(*) FROM users WHERE is_admin = 0 AND is_active = 0) AS inactive_users,
        (SELECT count(*) FROM bookings) AS all_bookings""",
    "g4_user_booking_stats": """
      SELECT u.user_id, coalesce(l.list_rows, 0) AS list_rows,
        (SELECT count(*) FROM bookings b WHERE b.user_id = u.user_id AND lower(b.status) = 'confirmed') AS confirmed,
        (SELECT count(*) FROM bookings b WHERE b.user_id = u.user_id AND lower(b.status) = 'pending') AS pending,
        CAST((SELECT coalesce(sum(total_amount), 0) FROM bookings b WHERE b.user_id = u.user_id) AS DECIMAL(18,2))
          AS total_spent
      FROM users u LEFT JOIN (
        SELECT b.user_id, count(*) AS list_rows FROM bookings b JOIN routes r ON r.route_id = b.route_id
          JOIN buses bus ON bus.bus_id = b.bus_id LEFT JOIN payments p ON p.booking_id = b.booking_id
        GROUP BY b.user_id) l ON l.user_id = u.user_id""",
    "g5_bus_list": """
      SELECT b.*, (SELECT count(*) FROM seats s WHERE s.bus_id = b.bus_id) AS seat_count,
        (SELECT count(*) FROM bus_route br WHERE br.bus_id = b.bus_id) AS route_count
      FROM buses b ORDER BY created_at DESC, bus_id DESC""",
    "g6_route_list": """
      SELECT r.*, (SELECT count(*) FROM bus_route br WHERE br.route_id = r.route_id) AS bus_count,
        (SELECT count(*) FROM bookings b WHERE b.route_id = r.route_id) AS booking_count
      FROM routes r ORDER BY created_at DESC, route_id DESC""",
    "g7_available_buses": "SELECT route_id, available_buses FROM with_buses",
    "g8_search_count": "SELECT count(*) AS routes_found FROM searched",
    "t1_recent": """
      SELECT b.*, u.username, r.route_name, bus.bus_number
      FROM bookings b JOIN users u ON u.user_id = b.user_id JOIN routes r ON r.route_id = b.route_id
        JOIN buses bus ON bus.bus_id = b.bus_id ORDER BY b.created_at DESC, b.booking_id DESC LIMIT 5""",
    "t2_popular": "SELECT * FROM routes WHERE is_active = 1 ORDER BY route_id LIMIT 5",
    "s1_cities": """
      SELECT min(city) AS city FROM (SELECT origin_city AS city FROM routes UNION ALL SELECT destination_city FROM routes)
      GROUP BY strip_accents(lower(city)) ORDER BY city""",
    "f0_expressions": f"""
      SELECT l.booking_id, l.payment_amount, strftime(l.journey_date, '%d %b %Y') AS journey_text,
        strftime(CAST('2000-01-01 ' || r.departure_time AS TIMESTAMP), '%I:%M %p') AS departure_text,
        {_grouped("l.total_amount")} AS total_text,
        format('{{:,.0f}}', CAST(round(l.total_amount, 0) AS DOUBLE)) AS total_rounded,
        concat('{V.CURRENCY}', {_grouped("l.total_amount")}) AS total_money,
        concat(upper(l.status[1]), l.status[2:]) AS status_text,
        CASE l.status WHEN 'confirmed' THEN 'success' WHEN 'pending' THEN 'warning' ELSE 'danger' END AS status_label,
        CASE WHEN l.payment_status IS NULL THEN 'Not Paid' ELSE 'Completed' END AS payment_label,
        CASE WHEN l.payment_status IS NOT NULL THEN concat('Paid via ', l.payment_method) END AS paid_via,
        CASE WHEN l.payment_status IS NULL THEN 'Pending' ELSE 'Paid' END AS paid_or_pending,
        CASE WHEN r.is_active = 1 THEN 'Active' ELSE 'Inactive' END AS route_state,
        CASE WHEN u.phone_number IS NULL OR u.phone_number IN ('', '0') THEN 'N/A' ELSE u.phone_number END AS phone,
        concat(u.first_name, ' ', u.last_name) AS full_name,
        concat(l.origin_city, '{V.ARROW}', l.destination_city) AS journey,
        replace(l.passenger_names, chr(10), concat('<br />', chr(10))) AS names_html,
        concat(l.username, ', ', l.email) AS contact,
        CASE WHEN l.passenger_names IS NULL THEN ''
          ELSE concat('&quot;A&amp;B&#039;', l.passenger_names) END AS clean,
        l.booking_id AS whole, CAST(r.fare AS DOUBLE) AS number,
        CAST(r.fare * l.seat_count AS DECIMAL(20,2)) AS fare_total,
        l.journey_date >= DATE '{JOURNEY_DATE}' AS upcoming,
        concat('TXN', strftime(l.booking_date, '%Y%m%d%H%M%S'), CAST(l.booking_id % 9000 + 1000 AS VARCHAR))
          AS transaction_code,
        concat('BKG', strftime(l.booking_date, '%Y%m%d'), CAST(l.booking_id % 9000 + 1000 AS VARCHAR)) AS booking_code,
        (u.phone_number IS NULL OR u.phone_number IN ('', '0')) AS no_phone
      FROM booking_list l JOIN routes r ON r.route_id = l.route_id JOIN users u ON u.user_id = l.user_id""",
    "f14_markup": """
      SELECT event_id, CASE event_id % 8 WHEN 0 THEN concat('a ', CAST(event_id AS VARCHAR), ' z')
        WHEN 1 THEN concat('x', CAST(event_id AS VARCHAR)) WHEN 2 THEN concat(CAST(event_id AS VARCHAR), ' &lt; 5')
        WHEN 3 THEN concat(CAST(event_id AS VARCHAR), ' ')
        WHEN 5 THEN concat(CAST(event_id AS VARCHAR), ' &amp; &quot;', CAST(event_id AS VARCHAR), '&quot;')
        WHEN 6 THEN '' ELSE CAST(event_id AS VARCHAR) END AS clean
      FROM events""",
    "w1_add_buses": f"""
      SELECT * FROM buses UNION ALL
      SELECT (SELECT max(bus_id) FROM buses) + 1 + request_id, bus_number, 'Model &amp; Co', license_plate, capacity,
        1, DATE '{AS_OF}' FROM new_buses""",
    "w1_add_buses_seats": """
      SELECT * FROM seats UNION ALL
      SELECT (SELECT max(seat_id) FROM seats) + 1 + request_id * (SELECT max(capacity) FROM new_buses) + i - 1,
        (SELECT max(bus_id) FROM buses) + 1 + request_id, concat('A', CAST(i AS VARCHAR))
      FROM (SELECT request_id, unnest(range(1, capacity + 1)) AS i FROM new_buses)""",
    "w2_edit_buses": """
      SELECT b.bus_id, b.created_at,
        CASE WHEN e.bus_id IS NULL THEN b.bus_number ELSE concat('Bus ', CAST(e.last_id AS VARCHAR)) END AS bus_number,
        CASE WHEN e.bus_id IS NULL THEN b.bus_model ELSE 'Model &amp; Co' END AS bus_model,
        CASE WHEN e.bus_id IS NULL THEN b.license_plate ELSE concat('LP-E', CAST(e.last_id AS VARCHAR)) END AS license_plate,
        CASE WHEN e.bus_id IS NULL THEN b.capacity ELSE CAST(10 + e.last_id % 51 AS INT) END AS capacity,
        CASE WHEN e.bus_id IS NULL THEN b.is_active WHEN e.last_value >= 10 THEN 1 ELSE 0 END AS is_active
      FROM buses b LEFT JOIN bus_edits e ON e.bus_id = b.bus_id""",
    "w3_delete_buses": "SELECT * FROM buses WHERE bus_id IN (SELECT bus_id FROM bookings)",
    "w3_delete_buses_rejects": f"""
      SELECT DISTINCT bus_id, '{V.REASON_BUS_BOOKED}' AS reason FROM bookings""",
    "w4_add_routes": f"""
      SELECT * FROM routes UNION ALL
      SELECT route_id, route_name, origin_city, destination_city, distance, fare, '01:30:00', '06:15:00', 1,
        DATE '{AS_OF}' FROM new_routes""",
    "w4_add_routes_assignments": """
      SELECT * FROM bus_route
      UNION ALL SELECT request_id % n_bus, route_id FROM new_routes, n WHERE p_size > 5
      UNION ALL SELECT (request_id + 1) % n_bus, route_id FROM new_routes, n WHERE p_size > 5""",
    "w5_edit_routes": """
      SELECT r.route_id, r.created_at, coalesce(e.fare, r.fare) AS fare, coalesce(e.is_active, r.is_active) AS is_active,
        CASE WHEN e.route_id IS NULL THEN r.route_name ELSE concat('Line ', CAST(e.event_id AS VARCHAR)) END AS route_name,
        CASE WHEN e.route_id IS NULL THEN r.origin_city
          ELSE concat('A &amp; ', CAST(e.event_id % 9 AS VARCHAR)) END AS origin_city,
        CASE WHEN e.route_id IS NULL THEN r.destination_city
          ELSE concat('B', CAST(e.event_id % 8 AS VARCHAR)) END AS destination_city,
        CASE WHEN e.route_id IS NULL THEN r.distance ELSE CAST(e.event_id % 900 AS INT) END AS distance,
        CASE WHEN e.route_id IS NULL THEN r.travel_time WHEN e.event_id % 6 <> 0 THEN '02:45:00' END AS travel_time,
        CASE WHEN e.route_id IS NULL THEN r.departure_time
          ELSE concat(lpad(CAST(e.event_id % 24 AS VARCHAR), 2, '0'), ':20:00') END AS departure_time
      FROM routes r LEFT JOIN route_edits e ON e.route_id = r.route_id""",
    "w1_add_buses_rejects": f"""
      SELECT s_suppkey AS request_id, '{V.REASON_CAPACITY}' AS reason FROM supplier
      WHERE s_suppkey % 25 <> 0 AND s_suppkey % 7 = 3""",
    "w2_edit_buses_rejects": f"""
      SELECT event_id AS change_id, '{V.REASON_CAPACITY}' AS reason FROM events
      WHERE event_type = 'error' AND event_id % 19 = 0""",
    "w4_add_routes_rejects": f"""
      SELECT p_partkey AS request_id, '{V.REASON_FARE}' AS reason FROM part WHERE p_partkey % 33 = 5""",
    "w5_edit_routes_rejects": f"""
      SELECT event_id AS change_id,
        CASE WHEN event_id % 43 = 0 THEN '{V.REASON_DISTANCE}' ELSE '{V.REASON_FARE}' END AS reason
      FROM events WHERE event_type = 'click' AND (event_id % 43 = 0 OR event_id % 41 = 0)""",
    "p3_search_results": """
      SELECT w.*, coalesce((SELECT string_agg(bus_number, ', ' ORDER BY b.bus_id) FROM bus_route br
        JOIN buses b ON b.bus_id = br.bus_id WHERE br.route_id = w.route_id AND b.is_active = 1), '') AS bus_numbers
      FROM with_buses w ORDER BY departure_time, route_id""",
    "w5_edit_routes_assignments": """
      SELECT bus_id, route_id FROM bus_route WHERE route_id NOT IN (SELECT route_id FROM route_edits)
      UNION ALL SELECT bus_id, route_id FROM route_edits""",
    "w6_delete_routes": "SELECT * FROM routes WHERE route_id IN (SELECT route_id FROM bookings)",
    "w6_delete_routes_rejects": f"""
      SELECT DISTINCT route_id, '{V.REASON_ROUTE_BOOKED}' AS reason FROM bookings""",
    "w7_set_user_active": """
      SELECT u.* EXCLUDE (is_active),
        CASE WHEN e.user_id IS NULL THEN u.is_active WHEN e.event_type = 'error' THEN 0 ELSE 1 END AS is_active
      FROM users u LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type
        FROM events GROUP BY user_id) e ON e.user_id = u.user_id""",
    "w8_apply_status": _with_status("booking_changes"),
    "w9_create_bookings": _with_requests("accepted_requests"),
    "w9_create_bookings_seats": _with_request_seats("accepted_requests"),
    "w9_no_clash": _with_requests("seated_requests"),
    "w9_no_clash_seats": _with_request_seats("seated_requests"),
    "w9_no_clash_rejects": f"""
      SELECT q.request_id, CASE WHEN coalesce(r.is_active, 0) = 0 THEN '{V.REASON_ROUTE}'
        WHEN q.n_seats = 0 THEN '{V.REASON_NO_SEAT}' ELSE '{V.REASON_SEAT}' END AS reason
      FROM booking_requests q LEFT JOIN routes r ON r.route_id = q.route_id
      WHERE q.request_id NOT IN (SELECT request_id FROM seated_requests)""",
    "w9_create_bookings_rejects": f"""
      SELECT request_id, CASE WHEN coalesce(r.is_active, 0) = 0 THEN '{V.REASON_ROUTE}'
        ELSE '{V.REASON_NO_SEAT}' END AS reason
      FROM booking_requests q LEFT JOIN routes r ON r.route_id = q.route_id
      WHERE coalesce(r.is_active, 0) = 0 OR q.n_seats = 0""",
    "w10_post_payments": """
      SELECT * FROM payments UNION ALL
      SELECT (SELECT max(payment_id) FROM payments) + 1 + change_id, booking_id, user_id, total_amount, payment_method,
        concat('TXN', strftime(ts, '%Y%m%d%H%M%S'), CAST(change_id % 9000 + 1000 AS VARCHAR)), 'completed'
      FROM accepted_pays""",
    "w10_post_payments_bookings": _with_status(
        "(SELECT booking_id, ts, change_id, 'confirmed' AS new_status FROM accepted_pays)"
    ),
    "w10_post_payments_rejects": f"""
      SELECT change_id, '{V.REASON_BOOKING}' AS reason FROM pay_requests
      WHERE change_id NOT IN (SELECT change_id FROM accepted_pays)""",
    "w10_apply_changes": _with_status("effective"),
    "w11_admit_users": """
      SELECT * FROM users UNION ALL
      SELECT (SELECT max(user_id) FROM users) + 1 + reg_id, username, first_name, last_name, email, phone_number, address,
        0, 1, CAST(ts AS DATE) FROM admitted_regs""",
    "w11_admit_users_rejects": f"""
      SELECT reg_id, concat_ws('; ', CASE WHEN incomplete THEN '{V.REASON_REQUIRED}' END,
        CASE WHEN name_taken THEN '{V.REASON_USERNAME}' END, CASE WHEN mail_taken THEN '{V.REASON_EMAIL}' END) AS reasons
      FROM judged_regs WHERE incomplete OR name_taken OR mail_taken""",
    "q1_double_sold": """
      SELECT seat_id, route_id, journey_date, count(DISTINCT booking_id) AS holders FROM holds
      GROUP BY ALL HAVING count(DISTINCT booking_id) > 1""",
    "q2_capacity": """
      SELECT b.bus_id, b.bus_number, b.capacity, count(s.seat_id) AS seat_count
      FROM buses b LEFT JOIN seats s ON s.bus_id = b.bus_id GROUP BY ALL HAVING count(s.seat_id) <> b.capacity""",
    "q3_fare": """
      SELECT b.booking_id, b.route_id, b.seat_count, b.total_amount, r.fare,
        CAST(r.fare * b.seat_count AS DECIMAL(20,2)) AS expected_amount
      FROM bookings b JOIN routes r ON r.route_id = b.route_id WHERE b.total_amount <> r.fare * b.seat_count""",
    "q4_payments": """
      WITH c AS (SELECT b.booking_id, b.status, b.total_amount, coalesce(p.n, 0) AS n_payments,
          CAST(coalesce(p.paid, 0) AS DECIMAL(18,2)) AS paid
        FROM bookings b LEFT JOIN (SELECT booking_id, count(*) AS n, sum(amount) AS paid FROM payments
          GROUP BY booking_id) p ON p.booking_id = b.booking_id)
      SELECT *, 'confirmed unpaid' AS finding FROM c WHERE lower(status) = 'confirmed' AND n_payments = 0
      UNION ALL SELECT *, 'cancelled paid' FROM c WHERE lower(status) = 'cancelled' AND n_payments > 0
      UNION ALL SELECT *, 'paid more than once' FROM c WHERE n_payments > 1""",
    "q5_unassigned_bus": """
      SELECT booking_id, bus_id, route_id, status FROM bookings b WHERE NOT EXISTS (
        SELECT 1 FROM bus_route br WHERE br.bus_id = b.bus_id AND br.route_id = b.route_id)""",
    "st1_status": """
      SELECT booking_id, arg_max(new_status, (ts, change_id)) AS status, max(ts) AS changed_at
      FROM effective GROUP BY booking_id""",
    "st2_payment_totals": """
      SELECT payment_method, count(*) AS n_payments, CAST(sum(total_amount) AS DECIMAL(18,2)) AS revenue
      FROM accepted_pays GROUP BY payment_method""",
}


def _kept(name: str) -> str:
    """A report over the bookings and payments after the change log and the requests."""
    report = _QUERIES[name]
    for table in ("bookings", "payments"):
        report = report.replace(f"FROM {table}", f"FROM kept_{table}").replace(f"JOIN {table}", f"JOIN kept_{table}")
    new = _with_requests("accepted_requests").replace("SELECT * FROM bookings UNION ALL", "")
    return f"""WITH kept_bookings AS (
      SELECT booking_id, user_id, route_id, bus_id, status, total_amount FROM ({_with_status("effective")})
      UNION ALL SELECT n.booking_id, n.user_id, n.route_id, n.bus_id, n.status, n.total_amount
      FROM ({new}) n({", ".join(TABLES["bookings"].names)})),
    kept_payments AS (
      SELECT booking_id, amount FROM payments UNION ALL SELECT booking_id, total_amount FROM accepted_pays)
    {report}"""


_QUERIES |= {
    "st4_users": _QUERIES["w11_admit_users"],
    "st4_rejects": _QUERIES["w11_admit_users_rejects"],
    "w2_stored_buses": _QUERIES["w2_edit_buses"],
    "w5_stored_routes": _QUERIES["w5_edit_routes"],
    "w5_stored_assignments": _QUERIES["w5_edit_routes_assignments"],
    "w7_stored_users": _QUERIES["w7_set_user_active"],
    "w8_stored_update": _QUERIES["w8_apply_status"],
    "w9_stored_no_clash": _QUERIES["w9_no_clash"],
    "w10_stored_changes": _QUERIES["w10_apply_changes"],
    "w10_stored_payments": _QUERIES["w10_post_payments"],
    "g1_kept_kpis": _kept("g1_kpis"),
    "g2_kept_user_stats": _kept("g2_user_stats"),
    "g4_kept_user_booking_stats": _kept("g4_user_booking_stats"),
    "g6_kept_route_list": _kept("g6_route_list"),
    "t1_stored_recent": f"""
      WITH kept_bookings AS (
        SELECT {", ".join(TABLES["bookings"].names)} FROM ({_with_status("effective")})
        UNION ALL {_with_requests("accepted_requests").replace("SELECT * FROM bookings UNION ALL", "")})
      {_QUERIES["t1_recent"].replace("FROM bookings", "FROM kept_bookings")}""",
    "st3_occupancy": f"""
      WITH kept AS ({_with_status("effective")}),
      kept_holds AS (
        SELECT DISTINCT bs.seat_id, b.route_id, b.journey_date FROM booking_seat bs JOIN kept b
          ON b.booking_id = bs.booking_id WHERE lower(b.status) <> 'cancelled')
      SELECT t.bus_id, t.route_id, t.journey_date, count(*) AS total_seats, count(h.seat_id) AS booked_seats,
        count(*) - count(h.seat_id) AS free_seats
      FROM trips t JOIN seats s ON s.bus_id = t.bus_id LEFT JOIN kept_holds h
        ON h.seat_id = s.seat_id AND h.route_id = t.route_id AND h.journey_date = t.journey_date
      GROUP BY t.bus_id, t.route_id, t.journey_date""",
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in _QUERIES.items():
        own = sql.strip()
        # A statement with definitions of its own continues the shared list.
        out[name] = _TABLES.strip() + (", " + own[len("WITH ") :] if own.startswith("WITH ") else "\n" + own)
    return out
