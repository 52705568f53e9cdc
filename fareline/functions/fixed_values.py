"""Texts and prefixes that results must carry exactly as they are."""

CURRENCY = "৳"

STATUS_PENDING = "pending"
STATUS_CONFIRMED = "confirmed"
STATUS_CANCELLED = "cancelled"

PAYMENT_COMPLETED = "completed"

TRANSACTION_PREFIX = "TXN"
BOOKING_PREFIX = "BKG"

LABEL_SUCCESS = "success"
LABEL_WARNING = "warning"
LABEL_DANGER = "danger"
LABEL_NOT_PAID = "Not Paid"
LABEL_PAID_VIA = "Paid via "
LABEL_PAID = "Paid"
LABEL_PENDING = "Pending"
LABEL_ACTIVE = "Active"
LABEL_INACTIVE = "Inactive"
LABEL_MISSING = "N/A"
ARROW = " → "

SEAT_PREFIX = "A"

REASON_ROUTE = "Route not found or inactive"
REASON_NO_SEAT = "Please select at least one seat"
REASON_BUS_BOOKED = "Cannot delete bus with existing bookings. Deactivate instead."
REASON_ROUTE_BOOKED = "Cannot delete route with existing bookings. Deactivate instead."
REASON_REQUIRED = "All required fields must be filled"
REASON_USERNAME = "Username already exists"
REASON_EMAIL = "Email already exists"
REASON_BOOKING = "Booking not found"
REASON_CAPACITY = "Capacity out of range"
REASON_DISTANCE = "Distance out of range"
REASON_FARE = "Fare out of range"
REASON_AMOUNT = "Total amount out of range"
REASON_SEAT = "Seat already booked"

# Characters removed at both ends of submitted text.
TRIMMED = " \n\r\t\x0b\x00"

# Replaced in this order: the ampersand comes first so that no entity is escaped twice.
HTML_ESCAPES = [
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#039;"),
]
