"""Table schemas, merge keys and the fixed values that stored data and users rely on."""

GEO = (
    "postal_code string, region string, province_name string, province string, "
    "pop bigint, share decimal(11,9)"
)
ESTIMATES = (
    "pk string, delivery_date date, weekly int, monthly bigint, original int, sender string, "
    "product string, province string, updated_at timestamp_ntz"
)
DECLARED_CAPACITY = (
    "capacity bigint, province string, tender_geokey string, p890 boolean, p_ar boolean, "
    "p_rs boolean, tender_id string, courier string, created_at timestamp_ntz, "
    "peak_capacity bigint, from_ts timestamp_ntz, to_ts timestamp_ntz, pk string, "
    "production_capacity bigint, updated_at timestamp_ntz"
)
POSTAL_CAPACITY = (
    "courier string, postal_code string, capacity int, peak_capacity int, "
    "from_ts timestamp_ntz, to_ts timestamp_ntz, products string"
)
RUN_CAPACITY = (
    "courier string, from_ts timestamp_ntz, to_ts timestamp_ntz, capacity bigint, "
    "sum_monthly bigint, sum_weekly bigint, region string, province string, p890 boolean, "
    "p_ar boolean, updated_at timestamp_ntz, is_default boolean, run_id int"
)
RUN_POSTAL_CAPACITY = (
    "courier string, from_ts timestamp_ntz, to_ts timestamp_ntz, capacity int, "
    "peak_capacity int, postal_code string, updated_at timestamp_ntz, run_id int"
)
RUNS = (
    "run_id int, name string, description string, status string, trigger string, "
    "executed_at timestamp_ntz, month string, capacity_type string, run_type string"
)

# Items of the paged service answers, as they are landed (all fields optional).
ESTIMATE_ITEM = (
    "deliveryDate string, monthlyEstimate double, originalEstimate int, paId string, pk string, "
    "productType string, province string, weeklyEstimate int"
)
CAPACITY_ITEM = (
    "activationDateFrom string, activationDateTo string, capacity bigint, createdAt string, "
    "geoKey string, peakCapacity bigint, pk string, products array<string>, tenderId string, "
    "tenderIdGeoKey string, unifiedDeliveryDriver string"
)
PIECE_ITEM = (
    "attempt string, cap string, productType string, province string, requestId string, "
    "senderPaId string, unifiedDeliveryDriver string, workflowStep string"
)
OVERRIDE_ROW = (
    "regione string, cod_sigla_provincia string, product string, postalizzazioni_mensili string, "
    "postalizzazioni_settimanali string, inizioPeriodoValidita string, "
    "finePeriodoValidita string, capacita string, capacita_reale string, "
    "capacita_bau_originale string, flag_default string"
)

# Keys of the upserts and of the duplicate removal.
ESTIMATE_KEYS = ["sender", "province", "product", "delivery_date"]
DECLARED_KEYS = ["province", "courier", "p890", "p_ar", "p_rs", "from_ts"]
RUN_CAPACITY_KEYS = ["courier", "run_id", "from_ts", "province"]
SENDER_RESULT_KEYS = ["run_id", "sender", "week"]
COURIER_RESULT_KEYS = ["run_id", "province", "region", "courier", "week"]
SERIES_KEYS = ["run_id", "province", "region", "courier"]

# They are stored in the tables or read by users, so they keep their spelling.
STATUS_DONE = "Lavorata"
STATUS_RUNNING = "In lavorazione"
STATUS_SCHEDULED = "Schedulata"
STATUS_INCOMPLETE = "Non completata"
STATUS_DRAFT = "Bozza"
TRIGGER_SCHEDULE = "Schedule"
TRIGGER_NOW = "Now"
CAPACITY_BASE = "BAU"
CAPACITY_PEAK = "Picco"
CAPACITY_MIXED = "Combinata"
CAPACITY_PRODUCTION = "Produzione"
RUN_MANUAL = "Manuale"
RUN_AUTOMATED = "Automatizzata"
STEP_RESIDUAL = "EVALUATE_SENDER_LIMIT"
STEP_PLANNED = "EVALUATE_PRINT_CAPACITY"
PEAK_LABELS = {0: "Assente", 1: "Presente"}
BAND_NONE = "No picchi"
BAND_LOW = "<50% picchi"
BAND_HIGH = ">=50% picchi"
BAND_ORDINALS = {BAND_NONE: 0, BAND_LOW: 1, BAND_HIGH: 2}
MONTH_NAMES = [
    "Gennaio", "Febbraio", "Marzo", "Aprile", "Maggio", "Giugno",
    "Luglio", "Agosto", "Settembre", "Ottobre", "Novembre", "Dicembre",
]
CSV_CAPACITY_HEADER = {
    "courier": "unifiedDeliveryDriver",
    "postal_code": "geoKey",
    "capacity": "capacity",
    "peak_capacity": "peakCapacity",
    "from_ts": "activationDateFrom",
    "to_ts": "activationDateTo",
    "products": "products",
}
CSV_PIECE_HEADER = {
    "request_id": "requestId",
    "sent_at": "notificationSentAt",
    "prepare_at": "prepareRequestDate",
    "product": "productType",
    "sender": "senderPaId",
    "province": "province",
    "postal_code": "cap",
    "attempt": "attempt",
    "iun": "iun",
}
MAX_CSV_ROWS = 10000
MAX_UPLOAD_ROWS = 9900
LOOKBACK_DAYS = 30
