"""Rosters, enrolment, account claims, uploads."""

from pyspark.sql import functions as F

from rubrica.operators import roster
from rubrica.session import shared_dir
from rubrica.sources import tables, uploads
from workload.registry import query, view

EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"

view(
    "v_roster",
    """
SELECT c_custkey % 25 AS exam_id, c_custkey AS row_no,
       CASE c_custkey % 11 WHEN 0 THEN '  ' WHEN 1 THEN 'ab1' WHEN 2 THEN concat('1by', CAST(100000 + c_custkey - 25 AS VARCHAR(12)))
            ELSE concat(' 1by', CAST(100000 + c_custkey AS VARCHAR(12)), ' ') END AS usn,
       CASE c_custkey % 11 WHEN 4 THEN '' ELSE c_name END AS name,
       CASE c_custkey % 11 WHEN 3 THEN 'nobody at home' WHEN 5 THEN '' ELSE concat('s', CAST(c_custkey AS VARCHAR(12)), '@example.org') END
           AS email
FROM customer
""",
)
view("v_known_student", "SELECT * FROM v_student WHERE student_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 15)")
view(
    "v_roster_enrollment",
    "SELECT c_custkey % 25 AS exam_id, c_custkey AS student_id FROM customer WHERE c_nationkey < 15 AND c_acctbal > 5000",
)
view(
    "s_roster_clean",
    f"""
SELECT *, NOT regexp_matches(usn, '^[0-9A-Za-z]{{6,15}}$') AS bad_usn,
       email <> '' AND NOT regexp_matches(email, '{EMAIL}') AS bad_email
FROM (SELECT exam_id, row_no, upper(trim(usn)) AS usn, trim(name) AS name, trim(email) AS email FROM v_roster)
""",
)
view(
    "s_roster_judged",
    """
SELECT *, CASE WHEN usn = '' THEN 'USN is missing' WHEN bad_usn THEN usn || ' looks malformed'
  WHEN row_no > first_row THEN usn || ' is a duplicate in this file' WHEN name = '' THEN usn || ': name is missing'
  WHEN bad_email THEN usn || ': email is not valid' END AS reason
FROM (SELECT *, min(CASE WHEN NOT bad_usn AND NOT bad_email AND name <> '' THEN row_no END) OVER (PARTITION BY exam_id, usn)
        AS first_row FROM s_roster_clean)
""",
)
view(
    "s_import",
    """
SELECT j.exam_id, j.row_no, j.usn, j.name, j.email, s.student_id,
       coalesce(j.reason, CASE WHEN e.student_id IS NOT NULL THEN j.usn || ' is already enrolled' END) AS reason
FROM s_roster_judged j LEFT JOIN v_known_student s ON s.usn = j.usn
LEFT JOIN v_roster_enrollment e ON e.exam_id = j.exam_id AND e.student_id = s.student_id
""",
)


def _import(t):
    return roster.import_roster(t("v_roster"), t("v_known_student"), t("v_roster_enrollment"))


@query("validate_roster", "SELECT exam_id, row_no, usn, reason FROM s_roster_judged")
def _(t):
    return roster.validate_roster(t("v_roster")).select("exam_id", "row_no", "usn", "reason")


@query(
    "first_valid_row",
    "SELECT exam_id, row_no, usn, first_row FROM s_roster_judged",
)
def _(t):
    rows = roster.validate_roster(t("v_roster")).withColumn("ok", F.col("reason").isNull())
    return roster.first_valid(rows, ["exam_id", "usn"], "ok", "row_no").select("exam_id", "row_no", "usn", "first_row")


@query(
    "import_roster",
    """SELECT exam_id, row_no, usn, student_id, reason, CASE WHEN reason IS NULL THEN 'created' ELSE 'skipped' END AS outcome
       FROM s_import""",
)
def _(t):
    return _import(t)[0].select("exam_id", "row_no", "usn", "student_id", "reason", "outcome")


@query(
    "imported_students",
    """SELECT usn, name, email FROM (SELECT *, row_number() OVER (PARTITION BY usn ORDER BY exam_id, row_no) AS k FROM s_import
       WHERE reason IS NULL AND student_id IS NULL) WHERE k = 1""",
)
def _(t):
    return _import(t)[1]


@query("imported_enrollments", "SELECT exam_id, usn, student_id FROM s_import WHERE reason IS NULL")
def _(t):
    return _import(t)[2]


@query(
    "import_report",
    """SELECT exam_id, count(*) FILTER (WHERE reason IS NULL) AS created, count(*) FILTER (WHERE reason IS NOT NULL) AS skipped
       FROM s_import GROUP BY exam_id""",
)
def _(t):
    return roster.import_report(_import(t)[0])[0]


@query(
    "import_errors",
    "SELECT exam_id, row_no, reason AS message FROM s_import WHERE reason IS NOT NULL ORDER BY exam_id, row_no",
)
def _(t):
    return roster.import_report(_import(t)[0])[1]


@query(
    "enrolled_uploads",
    """SELECT s.sheet_id, s.exam_id, s.student_id FROM v_sheet s WHERE EXISTS (SELECT 1 FROM v_enrollment e
       WHERE e.exam_id = s.exam_id AND e.student_id = s.student_id)""",
)
def _(t):
    return roster.enrolled(t("v_sheet").select("sheet_id", "exam_id", "student_id"), t("v_enrollment"))


@query(
    "not_enrolled_uploads",
    """SELECT s.sheet_id, s.exam_id, s.student_id, 'This student is not enrolled in this exam.' AS reason FROM v_sheet s
       WHERE NOT EXISTS (SELECT 1 FROM v_enrollment e WHERE e.exam_id = s.exam_id AND e.student_id = s.student_id)""",
)
def _(t):
    return roster.not_enrolled(t("v_sheet").select("sheet_id", "exam_id", "student_id"), t("v_enrollment"))


view(
    "v_registration",
    """
SELECT o_orderkey AS reg_id, CASE WHEN o_orderstatus = 'P' THEN 'TEACHER' ELSE 'STUDENT' END AS role,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' THEN '' WHEN o_orderpriority = '1-URGENT' THEN ' '
            WHEN o_orderpriority = '2-HIGH' THEN '1by-0' ELSE concat('1by', CAST(100000 + 2 * o_custkey AS VARCHAR(12))) END AS usn,
       concat('User ', CAST(o_orderkey AS VARCHAR(12))) AS full_name,
       concat('u', CAST(o_orderkey AS VARCHAR(12)), '@example.org') AS email, o_orderkey + 1000000 AS new_user_id
FROM orders
""",
)
view("v_claimable", "SELECT student_id, usn, name, CASE WHEN student_id % 3 = 0 THEN '' ELSE email END AS email, user_id FROM v_student")
view(
    "s_claim",
    """
WITH c AS (SELECT *, upper(trim(usn)) AS u FROM v_registration),
k AS (SELECT *, CASE WHEN role = 'STUDENT' AND u = '' THEN 'This field is required for students.'
        WHEN role = 'STUDENT' AND NOT regexp_matches(u, '^[0-9A-Z]{6,15}$') THEN 'USN looks malformed.'
        WHEN role = 'TEACHER' AND u <> '' THEN 'USN must not be set for teacher accounts.' END AS early FROM c),
f AS (SELECT *, min(CASE WHEN role = 'STUDENT' AND early IS NULL THEN reg_id END) OVER (PARTITION BY u) AS first_id FROM k)
SELECT f.*, s.student_id, s.name AS s_name, s.email AS s_email, coalesce(early, CASE WHEN role = 'STUDENT' AND
    (s.user_id IS NOT NULL OR reg_id > first_id) THEN 'A student with this USN is already registered.' END) AS reason
FROM f LEFT JOIN v_claimable s ON s.usn = f.u
""",
)


@query(
    "claim_students",
    """SELECT reg_id, role, u AS usn, reason, CASE WHEN reason IS NOT NULL THEN 'reject' WHEN role = 'TEACHER' THEN 'none'
         WHEN student_id IS NULL THEN 'create' ELSE 'link' END AS action FROM s_claim""",
)
def _(t):
    return roster.claim_students(t("v_registration"), t("v_claimable"))[0]


@query(
    "claimed_students",
    """SELECT u AS usn, coalesce(s_name, full_name) AS name, CASE WHEN coalesce(s_email, '') = '' THEN email ELSE s_email END AS email,
         new_user_id AS user_id, CASE WHEN student_id IS NULL THEN 'create' ELSE 'link' END AS action
       FROM s_claim WHERE reason IS NULL AND role = 'STUDENT'""",
)
def _(t):
    return roster.claim_students(t("v_registration"), t("v_claimable"))[1]


# ---- files -----------------------------------------------------------------------------------------
view(
    "v_upload_file",
    """
SELECT CASE WHEN lang = 'fr' THEN CAST(floor(doc_id / 100) AS BIGINT) ELSE 100000 + CAST(floor(doc_id / 10) AS BIGINT) END AS upload_id,
       doc_id AS file_no, concat('p', CAST(doc_id AS VARCHAR(12))) AS name,
       CASE WHEN doc_id % 37 = 5 THEN 'text/plain' WHEN doc_id % 3 = 0 THEN 'image/jpeg' WHEN doc_id % 3 = 1 THEN 'image/png'
            ELSE 'application/pdf' END AS declared,
       n_chars * 2100 AS size,
       CASE WHEN doc_id % 41 = 7 THEN '4D5A90000300' WHEN doc_id % 3 = 0 THEN 'FFD8FFE000104A46' WHEN doc_id % 3 = 1
            THEN '89504E470D0A1A0A' ELSE '255044462D312E37' END AS head
FROM documents
""",
)
view(
    "s_upload",
    """
SELECT upload_id, count(*) AS page_count, sum(size)::BIGINT AS total_bytes, arg_min(r, file_no) FILTER (WHERE r IS NOT NULL) AS f
FROM (SELECT *, CASE WHEN declared = 'text/plain' THEN name || ': only JPG, PNG and PDF are accepted.'
        WHEN size > 10485760 THEN name || ': larger than 10 MB.'
        WHEN NOT ((declared = 'image/jpeg' AND head LIKE 'FFD8FF%') OR (declared = 'image/png' AND head LIKE '89504E470D0A1A0A%')
          OR (declared = 'application/pdf' AND head LIKE '255044462D%'))
        THEN name || ': file content doesn''t match a JPG, PNG or PDF.' END AS r FROM v_upload_file) GROUP BY upload_id
""",
)
view(
    "s_upload_judged",
    """
SELECT upload_id, page_count, total_bytes, CASE WHEN page_count > 20 THEN 'Ensure this field has no more than 20 elements.'
  WHEN f IS NOT NULL THEN f WHEN total_bytes > 41943040
  THEN concat('Upload is ', total_bytes // 1048576, ' MB total — the limit is 40 MB.') END AS reason FROM s_upload
""",
)


def _files(t):
    return t("v_upload_file").withColumn("content", F.unhex("head"))


@query("admit_uploads", "SELECT upload_id, page_count, total_bytes, reason FROM s_upload_judged")
def _(t):
    return uploads.admit_uploads(_files(t))


@query(
    "admitted_files",
    """SELECT f.upload_id, f.file_no, f.declared FROM v_upload_file f JOIN s_upload_judged j ON j.upload_id = f.upload_id
       WHERE j.reason IS NULL""",
)
def _(t):
    return uploads.admitted_files(_files(t)).select("upload_id", "file_no", "declared")


@query(
    "read_roster",
    r"""SELECT CAST(floor(c_custkey / 60) AS BIGINT) AS file_no,
          row_number() OVER (PARTITION BY floor(c_custkey / 60) ORDER BY c_custkey) AS row_no,
          concat('1BY', 100000 + c_custkey) AS usn, replace(c_name, '#', ', ') || ' "x"' AS name,
          CASE WHEN floor(c_custkey / 60) % 3 = 2 THEN '' ELSE concat('s', c_custkey, '@example.org') END AS email FROM customer""",
)
def _(t):
    """Write class lists of sixty in three layouts (headed, positional, partly headed), then scan them."""
    kind = F.floor(F.col("c_custkey") / 60) % 3
    name = F.concat(F.lit('"'), F.regexp_replace("c_name", "#", ", "), F.lit(' ""x"""'))
    usn, mail = F.concat(F.lit("1BY"), F.col("c_custkey") + 100000), F.concat(F.lit("s"), "c_custkey", F.lit("@example.org"))
    line = (
        F.when(kind == 0, F.concat_ws(",", name, mail, usn))
        .when(kind == 1, F.concat_ws(",", usn, name, mail))
        .otherwise(F.concat_ws(",", F.lit("7"), usn, name))
    )
    head = F.when(kind == 0, "Student_Name,Email-ID,USN\r\n\r\n").when(kind == 1, "").otherwise("no,Reg No,Full Name\n")
    lists = (
        t("customer")
        .select(F.floor(F.col("c_custkey") / 60).alias("file_no"), head.alias("head"), line.alias("line"), "c_custkey")
        .groupBy("file_no", "head")
        .agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY c_custkey)").alias("body"))
        .select("file_no", F.concat("head", "body", F.lit("\n\n")).alias("value"))
    )
    path = shared_dir(t.spark, "rosters")
    lists.repartition("file_no").write.partitionBy("file_no").text(path)
    rows = tables.read_roster(t.spark, path)
    file_no = F.regexp_extract("file", r"file_no=(\d+)", 1).cast("bigint")
    return rows.select(file_no.alias("file_no"), "row_no", "usn", "name", "email")


@query(
    "reject_pages",
    """SELECT upload_id, file_no, CASE WHEN ok AND declared = 'application/pdf' AND pdf_pages > 20
           THEN concat('PDF has ', pdf_pages, ' pages — the limit is 20.') ELSE 'Could not decode uploaded page' END AS reason
       FROM (SELECT *, size // 2100 % 45 AS pdf_pages, (declared = 'image/jpeg' AND head LIKE 'FFD8FF%') OR (declared = 'image/png' AND
           head LIKE '89504E470D0A1A0A%') OR (declared = 'application/pdf' AND head LIKE '255044462D%') AS ok FROM v_upload_file)
       WHERE NOT ok OR (declared = 'application/pdf' AND pdf_pages > 20)""",
)
def _(t):
    files = _files(t).withColumns(
        {
            "content_type": F.col("declared"),
            "actual_type": uploads.signature_type(F.col("content")),
            "pdf_pages": F.floor(F.col("size") / 2100) % 45,
        }
    )
    return uploads.reject_pages(files).select("upload_id", "file_no", "reason")
