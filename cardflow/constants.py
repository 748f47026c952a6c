"""Fixed values that must equal the card pipeline's behaviour.

Everything here is a plain value (thresholds, templates, labels, prices,
planning defaults).  Operators import from this module so that a value is
stated once.
"""

from decimal import Decimal

# ---------------------------------------------------------------------------
# Fixed values (must match the behaviour being reproduced)
# ---------------------------------------------------------------------------

# Transaction statuses that are actually written.
STATUS_AUTHORIZED = "AUTHORIZED"
STATUS_HELD = "HELD_FOR_REVIEW"
STATUS_SETTLED = "SETTLED"

# Every status a transaction can take (the model's enumeration).
STATUSES = ["AUTHORIZED", "DECLINED", "SETTLED", "REVERSED", "HELD_FOR_REVIEW"]

# Authorization outcomes.
OUTCOME_APPROVED = "APPROVED"
OUTCOME_DUPLICATE = "DUPLICATE"

# Feed stages, in display order.
STAGE_ORDER = ["RECORDED", "QUEUED", "SCORED", "ALERTED", "SETTLED"]
STAGE_RECORDED = "RECORDED"
STAGE_QUEUED = "QUEUED"
STAGE_SCORED = "SCORED"
STAGE_ALERTED = "ALERTED"
STAGE_SETTLED = "SETTLED"

# Card masking prefix (followed by the last four digits).
MASK_PREFIX = "**** **** **** "
# Minimum accepted card-number length.
MIN_PAN_LENGTH = 12
# Encryption context attached to every card-number ciphertext.
ENCRYPTION_CONTEXT = "purpose=card-authorization"

# Validation labels, in the order they are reported, and the message prefix.
LABEL_MERCHANT = "merchantId"
LABEL_PAN = "pan (12+ digits)"
LABEL_AMOUNT = "amount"
LABEL_CURRENCY = "currency"
VALIDATION_PREFIX = "Missing/invalid fields: "
# Form-only rules (strict mode): max card length and amount pattern.
FORM_MAX_PAN_LENGTH = 19
FORM_AMOUNT_PATTERN = r"^[0-9]+(\.[0-9]{1,2})?$"
FORM_CURRENCIES = ["USD", "EUR", "GBP"]

# Fraud scoring: amounts strictly above the threshold get the high score.
HIGH_VALUE_THRESHOLD = Decimal("2500")
HIGH_RISK_SCORE = 0.92
LOW_RISK_SCORE = 0.15
ALERT_ABOVE = 0.75
CRITICAL_ABOVE = 0.85
SEVERITY_CRITICAL = "CRITICAL"
SEVERITY_WARNING = "WARNING"

# Alert notification.
ALERT_SUBJECT = "High-risk transaction flagged"
ALERT_TEMPLATE = (
    '{"transactionId":"%s","merchantId":"%s","maskedPan":"%s",'
    '"amount":%s,"riskScore":%.2f}'
)

# Object keys.
RECEIPT_KEY_TEMPLATE = "receipts/%s/%s.json"
SUMMARY_KEY_TEMPLATE = "settlements/%s.json"
BATCH_ID_PREFIX = "batch-"

# Settlement notification.
SETTLEMENT_SUBJECT_PREFIX = "Settlement batch complete: "
SETTLEMENT_MESSAGE_TEMPLATE = "Settled %d transaction(s) totaling %s"

# Velocity alert line: card, count, window start and end (ISO instants).
VELOCITY_ALERT_TEMPLATE = "   >>> VELOCITY ALERT: card=%s count=%d window=[%s - %s]"

# Velocity check: window, grace and inclusive threshold.
VELOCITY_WINDOW = "30 seconds"
VELOCITY_GRACE = "5 seconds"
VELOCITY_THRESHOLD = 3

# Display.
PENDING_LABEL = "pending…"
ROW_DUPLICATE = "status-duplicate"
ROW_ALERTED = "status-alerted"
ROW_APPROVED = "status-approved"
STATUS_DUPLICATE_LABEL = "DUPLICATE"

# Capacity planning defaults.
PLAN_THROUGHPUT = 5000
PLAN_LATENCY_MS = 200
PLAN_BUFFER_PCT = 25
PLAN_THREAD_POOL = 50
PLAN_HEAP_MB = 1024.0
PLAN_MEM_PER_REQUEST_MB = 2.0
MODEL_PLATFORM = "Blocking — platform threads"
MODEL_VIRTUAL = "Blocking — virtual threads"
MODEL_ASYNC = "Non-blocking / async"

# Storage planning defaults.
STORAGE_DAILY = 50000
STORAGE_ITEM_KB = 2.0
STORAGE_YEARS = 7
STORAGE_GROWTH_PCT = 15
STORAGE_INDEXES = 1
STORAGE_COPIES = 1
# Storage tiers and their price per GB-month; the first is the reference tier.
TIER_PRICES = [
    ("hot", 0.25),
    ("warm", 0.023),
    ("cold", 0.00099),
]
