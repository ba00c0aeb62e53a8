"""Fixed values shared by every job.

The numbers, enumerations and word lists below are part of the grading contract: changing one changes
results, so they live here and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: enumerations -------------------------------------------------------------------
STATUSES = ("QUEUED", "RUNNING", "DONE", "FAILED", "APPROVED")
TERMINAL_STATUSES = ("DONE", "FAILED", "APPROVED")
STAGES = (
    "queued",
    "preprocessing",
    "segmentation",
    "annotations",
    "adjudication",
    "ocr",
    "specialized",
    "reconstruction",
    "retrieval",
    "coverage",
    "scoring",
    "feedback",
    "done",
)
BANDS = ("GREEN", "ORANGE", "RED")
VERDICTS = ("COVERED", "PARTIAL", "MISSING")
CONTENT_TYPES = ("TEXT", "DIAGRAM", "TABLE", "EQUATION")
MARK_KINDS = ("STRIKE", "UNDERLINE", "ARROW", "MARGIN")
MARK_INTENTS = ("CORRECTION", "EMPHASIS", "INSERTION")
DEFAULT_INTENT = {
    "STRIKE": "CORRECTION",
    "UNDERLINE": "EMPHASIS",
    "ARROW": "INSERTION",
    "MARGIN": "INSERTION",
}

# --- fixed values: stop words of the keyword verdict ----------------------------------------------
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "of", "in", "on", "to", "for",
    "and", "or", "it", "its", "that", "this", "as", "by", "with", "be",
)

# --- fixed values: white space as the grading rules understand it (Unicode) -------------------------
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# --- fixed values: upload signatures (hex of the leading bytes) and limits --------------------------
SIGNATURES = {"image/jpeg": "FFD8FF", "image/png": "89504E470D0A1A0A", "application/pdf": "255044462D"}
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_UPLOAD_BYTES = 40 * 1024 * 1024
MAX_PAGES = 20

# --- fixed values: roster header aliases ------------------------------------------------------------
ROSTER_ALIASES = {
    "usn": "usn",
    "usn no": "usn",
    "university seat number": "usn",
    "reg": "usn",
    "reg no": "usn",
    "name": "name",
    "student name": "name",
    "full name": "name",
    "email": "email",
    "email id": "email",
    "mail": "email",
}
USN_PATTERN = r"^[0-9A-Za-z]{6,15}$"
EMAIL_PATTERN = rf"^[^{WS[1:-1]}@]+@[^{WS[1:-1]}@]+\.[^{WS[1:-1]}@]+$"

# --- fixed values: messages -------------------------------------------------------------------------
CANCELLED_MESSAGE = "Cancelled by teacher."
PAGE_FAILED_MESSAGE = "Evaluation failed: no readable reply for page "
OVERLOAD_MESSAGE = "The AI provider is currently overloaded or rate-limited — try again in a few minutes."
STUCK_RUNNING_MESSAGE = "Task automatically reset: worker was killed or disconnected during evaluation."
STUCK_QUEUED_MESSAGE = (
    "Task automatically reset: queued for longer than {minutes} minutes with no worker picking it up."
)
OVERLOAD_PATTERN = r"rate limit|ratelimit|429|503|overloaded|timeout|connection"
EMPTY_EXCERPT = "(nothing relevant was retrieved from the answer)"


# --- fixed values: cut-offs and weights ---
@dataclass(frozen=True)
class Thresholds:
    """Cut-offs and weights; pass a changed copy to a job to calibrate it."""

    ambiguity: float = 0.70
    ocr_quality: float = 0.60
    ocr_confidence: float = 0.65
    text_density: float = 0.15
    full_credit: float = 0.72
    partial_credit: float = 0.50
    underline_boost: float = 1.10
    top_k: int = 3
    weight_tolerance: float = 0.01
    concept_cap: int = 8
    passes: int = 1
    weight_ocr: float = 0.35
    weight_passes: float = 0.40
    weight_retrieval: float = 0.25
    green: float = 0.80
    orange: float = 0.65
    line_tolerance: float = 12.0
    anchor_distance: float = 300.0
    strike_pad: float = 12.0
    iou: float = 0.3
    long_sentence: int = 90
    short_clause: int = 15
    stuck_minutes: int = 15
    calls_per_minute: int = 20


DEFAULTS = Thresholds()
