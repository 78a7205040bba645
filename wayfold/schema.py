"""Table schemas as Spark DDL."""

POSITIONS = (
    "reading_id string, vehicle_id string, recorded_at timestamp, received_at timestamp, "
    "lat double, lon double, speed_mps float, heading_deg float, accuracy_m float, "
    "battery_pct smallint, motion_state string"
)
VEHICLES = "id string, external_id string, label string, created_at timestamp"
TRIPS = (
    "id string, vehicle_id string, source string, started_at timestamp, ended_at timestamp, "
    "distance_m double, received_at timestamp"
)
STOP_EVENTS = (
    "id string, vehicle_id string, trip_id string, source string, arrived_at timestamp, "
    "departed_at timestamp, lat double, lon double, received_at timestamp"
)
MATCHES = (
    "client_event_id string, derived_event_id string, delta_seconds int, delta_meters double, "
    "matched_at timestamp"
)
READING = (
    "struct<reading_id:string,recorded_at:timestamp,lat:double,lon:double,speed_mps:float,"
    "heading_deg:float,accuracy_m:float,battery_pct:smallint,motion_state:string>"
)
STOP_REPORT = (
    "struct<event_id:string,arrived_at:timestamp,departed_at:timestamp,lat:double,lon:double>"
)
BATCH = (
    f"device_id string, sent_at timestamp, readings array<{READING}>, "
    f"stop_events array<{STOP_REPORT}>"
)
BATCH_TEXT = BATCH.replace("timestamp", "string")
FIXES = (
    "device_id string, recorded_at timestamp, lat double, lon double, speed_mps double, "
    "accuracy_m double"
)
LEDGER = (
    "id string, device_id string, kind string, recorded_at timestamp, payload string, "
    "attempts int, last_error string, created_at timestamp"
)
