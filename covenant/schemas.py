"""Constants, schemas and small dimension tables shared by all operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the results to match.
# ---------------------------------------------------------------------------

# The ten risk clauses, in their fixed order.
RISK_CLAUSES = [
    "Anti-Assignment",
    "Audit Rights",
    "Change Of Control",
    "Most Favored Nation",
    "Non-Compete",
    "Uncapped Liability",
    "Exclusivity",
    "Termination For Convenience",
    "Ip Ownership Assignment",
    "Liquidated Damages",
]

# Risk labels in ordinal order (label id = position): Low 0, Medium 1, High 2.
LABELS = ["Low", "Medium", "High"]
# Right-closed score buckets: (-1, 2] Low, (2, 4] Medium, (4, 10] High.
LABEL_UPPER_BOUNDS = [2, 4, 10]
LABEL_LOWER_BOUND = -1
# Class weights for Low / Medium / High in the weighted loss.
CLASS_WEIGHTS = [1.0, 1.6, 1.6]
WORDS_PER_CLAUSE = 20
MAX_TOKENS = 512

# Document statuses with their display text.
STATUSES = [
    ("Draft", "Draft"),
    ("UnderReview", "Under review"),
    ("RevisionRequested", "Revision requested"),
    ("Approved", "Approved"),
    ("Locked", "Locked"),
]
# The only legal status moves.
TRANSITIONS = [
    ("Draft", "UnderReview"),
    ("UnderReview", "RevisionRequested"),
    ("UnderReview", "Approved"),
    ("RevisionRequested", "UnderReview"),
    ("Approved", "Locked"),
]
# Audit actions with their display text.
ACTIONS = [
    ("Uploaded", "Uploaded"),
    ("Classified", "Classified"),
    ("ReviewRequested", "Sent for review"),
    ("RevisionRequested", "Revision requested"),
    ("Resubmitted", "Resubmitted"),
    ("Approved", "Approved"),
    ("Locked", "Locked"),
    ("Viewed", "Viewed"),
    ("ClassificationSkipped", "Not scored"),
    ("IntegrityVerified", "Integrity verified"),
    ("IntegrityCheckFailed", "Integrity check failed"),
]
# Actions that move a document's status, and the status they move it to.
STATUS_MOVES = [
    ("ReviewRequested", "UnderReview"),
    ("RevisionRequested", "RevisionRequested"),
    ("Approved", "Approved"),
    ("Locked", "Locked"),
]
ROLES = [
    ("Employee", "Employee"),
    ("ReviewerCompliance", "Compliance reviewer"),
    ("TechnicalAdmin", "Technical admin"),
]

# Display name for log rows without a human actor (a parameter of the audit feeds).
SYSTEM_ACTOR = "System"
NOTE_LIMIT = 500          # longer notes are cut to 497 chars + "..."
PREVIEW_LIMIT = 40_000    # text preview cut, followed by PREVIEW_MARKER
PREVIEW_MARKER = "\n\n[Preview truncated]"
UPLOAD_EXTENSIONS = [".pdf", ".docx", ".txt"]
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
DISPLAY_TZ = "Asia/Kolkata"
DISPLAY_TS_FORMAT = "d MMM yyyy, HH:mm"
SAFE_ID_MAX = 80
KEY_LIMIT = 500           # characters of a storage key

NOT_SCORED = (
    "Not risk-scored: automatic clause extraction for uploaded files is not built yet. "
    "The reviewer judges risk directly."
)
MSG_EMPTY_UPLOAD = "Choose a file to upload."
MSG_BAD_EXTENSION = "Upload a PDF, Word (.docx) or text (.txt) file."
MSG_REVISION_NOTE = "Explain what needs to change before requesting a revision."
MSG_NOT_OWNER = "Only the person who submitted this document can resubmit it."
MSG_SELF_REVIEW = "You can't review a document you submitted."
MSG_RESUBMIT_STATE = "Only documents with a requested revision can be resubmitted."
MSG_HASH_MISMATCH = (
    "The stored file no longer matches the hash recorded at upload, "
    "so it was not locked. Investigate before approving."
)
MSG_NO_MODEL_INPUT = "No model input in the prepared CUAD file, so there is no model prediction. "
RULE_PHRASE = " of {} risk clauses present (rule label "
MSG_PREDICTED, MSG_CONFIDENCE = "Model predicted ", "% confidence). "
MSG_UNKNOWN_DOCUMENT = "Document {} not found"
MSG_UNREADABLE = "Could not read "
RESUBMIT_NOTE = (
    "Version {} was uploaded by hand, so it has no risk score. "
    "Earlier scores applied to earlier versions only."
)
STEP_UPLOADED, STEP_SCORED, STEP_NOT_SCORED = "Uploaded", "Risk scored", "Not scored"
STEP_REVIEW, STEP_REVISION = "Under review", "Revision requested"
STEP_APPROVED, STEP_LOCKED = "Approved", "Locked"
MSG_NO_CLASSIFIER = "The classifier service did not respond, so there is no model prediction. "
LOCK_NOTE_TAIL = ". Production applies S3 Object Lock (Compliance mode) at this step."

# ---------------------------------------------------------------------------
# Fixture parameters (FIXTURES.md).
# ---------------------------------------------------------------------------
N_CLAUSE_TYPES = 41
QUESTION_PREFIX = 'Highlight the parts (if any) of this contract related to "'
QUESTION_SUFFIX = '" that should be reviewed by a lawyer.'
SPLIT_SEED = 42
SAMPLE_SEED = 7
AS_OF = "2024-02-01 00:00:00"

# ---------------------------------------------------------------------------
# Schemas.
# ---------------------------------------------------------------------------
QA_SCHEMA = T.StructType([
    T.StructField("row_ord", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("answers", T.StructType([T.StructField("text", T.ArrayType(T.StringType()))])),
])

SNIPPETS_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("risk_score", T.IntegerType()),
    T.StructField("risk_label", T.StringType()),
    T.StructField("clauses", T.MapType(T.StringType(), T.StringType())),
    T.StructField("model_input", T.StringType()),
])

def _dim(spark: SparkSession, rows, names) -> DataFrame:
    return spark.createDataFrame(rows, schema=T.StructType([T.StructField(n, T.StringType(), False) for n in names]))


def status_dim(spark: SparkSession) -> DataFrame:
    """Five-row status dimension (status, status_label); always small, safe to broadcast."""
    return _dim(spark, STATUSES, ["status", "status_label"])


def action_dim(spark: SparkSession) -> DataFrame:
    return _dim(spark, ACTIONS, ["action", "action_label"])


def role_dim(spark: SparkSession) -> DataFrame:
    return _dim(spark, ROLES, ["role", "role_label"])
