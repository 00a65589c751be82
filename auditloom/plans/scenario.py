"""Audit tables derived from the given star-schema tables.

Orders play the documents (five priorities, five document types), line items the
extraction attempts and amounts, events the run logs, labels the visual verdicts
and benchmark texts the learnings.  Everything is a narrow projection or one
aggregation of a given table, so the work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import rule_number
from ..operators.scale import dealt, grown

# The five document types, by order priority.
TYPES = (
    ("1-URGENT", "VIAJES", "VIA"),
    ("2-HIGH", "PERS_LOCAL", "PL"),
    ("3-MEDIUM", "PERS_SEDE", "PS"),
    ("4-NOT SPECIFIED", "EQUIPOS", "EQ"),
    ("5-LOW", "CONSUMIBLES", "CO"),
)

# field_id, field_name, data_type, required, label, aliases
FIELDS = (
    ("F_VENDOR", "vendor_name", "string", True, "Vendor name", "Supplier,Issuer"),
    ("F_NUMBER", "invoice_number", "string", True, "Invoice number", "Invoice no,Folio"),
    ("F_DATE", "invoice_date", "date", True, "Invoice date", "Date"),
    ("F_CURR", "currency", "string", False, "Currency", "Moneda"),
    ("F_NET", "net_amount", "decimal", True, "Net amount", "Base imponible"),
    ("F_TAX", "tax_amount", "decimal", False, "Tax amount", "IVA,VAT"),
    ("F_GROSS", "gross_amount", "decimal", True, "Gross amount", "Total"),
    ("F_RATE", "vat_rate", "decimal", False, "VAT rate", "Tipo IVA"),
    ("F_UNITS", "units", "decimal", False, "Units", "Quantity"),
    ("F_PRICE", "unit_rate", "decimal", False, "Unit rate", "Rate"),
    ("F_LINE", "line_total", "decimal", False, "Line total", "Importe"),
    ("F_REV", "reverse_charge", "string", False, "Reverse charge", ""),
)

# suffix, rule_name, field_id, check_type, check_value, severity, error_message, group, types (blank = all)
RULES = (
    ("001", "vendor_required", "F_VENDOR", "required", "", "error", "Vendor name is missing", "general", ""),
    ("002", "invoice_number_format", "F_NUMBER", "regex", "INV-[0-9]+5", "error", "Invoice number has another format", "general", ""),
    ("003", "vat_rate_range", "F_RATE", "range", "1,6", "warning", "VAT rate outside the usual range", "general", ""),
    ("004", "net_amount_range", "F_NET", "range", "100,250000", "error", "Net amount outside the range", "general", ""),
    ("005", "currency_allowed", "F_CURR", "enum", "EUR, USD ,GBP", "warning", "Currency not identified", "general", ""),
    ("006", "gross_total_matches", "F_GROSS", "cross_field", "net_amount + tax_amount", "error", "", "general", ""),
    ("007", "line_total_matches", "F_LINE", "cross_field", "units * unit_rate", "warning", "", "general", "VIAJES,EQUIPOS"),
    ("008", "reverse_charge_zero_vat", "F_REV", "conditional_check", "if reverse_charge=true then vat_rate=0", "warning", "Reverse charge needs zero VAT", "general", "EQUIPOS,CONSUMIBLES"),
    ("009", "reference_present", "F_NUMBER", "required_one_of", "F_DATE, F_VENDOR", "error", "No reference at all", "general", "PERS_LOCAL,PERS_SEDE"),
    ("010", "stamp_present", "VISUAL", "visual_check", "official stamp or seal visible", "error", "Stamp missing", "grants", ""),
    ("011", "proof_of_payment_attached", "VISUAL", "visual_check", "bank receipt present", "warning", "Proof of payment missing", "grants", "VIAJES,CONSUMIBLES"),
    ("012", "ratio_check", "F_TAX", "cross_field", "net_amount / (units - units)", "warning", "", "general", "EQUIPOS"),
    ("013", "future_check", "F_DATE", "checksum", "x", "warning", "", "general", "CONSUMIBLES"),
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rule_rows() -> list[tuple]:
    rows = []
    order = 0
    for _, type_id, short in TYPES:
        for suffix, name, field, check, value, severity, message, group, only in RULES:
            if only and type_id not in only.split(","):
                continue
            order += 1
            rows.append((f"R_{short}_{suffix}", type_id, name, field, check, value, severity,
                         f"Look at {name.replace('_', ' ')}", message, "body", group, order))
    return rows


RULE_COLUMNS = (
    "rule_id string, invoice_type_id string, rule_name string, field_id string, check_type string, "
    "check_value string, severity string, agent_hint string, error_message string, page_region string, "
    "rule_group string, rule_order int"
)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), RULE_COLUMNS)


def field_rows() -> list[tuple]:
    return [
        (fid, type_id, name, label, kind, need, [a for a in aliases.split(",") if a],
         ["EUR", "USD", "GBP"] if name == "currency" else [])
        for _, type_id, _ in TYPES
        for fid, name, kind, need, label, aliases in FIELDS
    ]


def fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        field_rows(),
        "field_id string, invoice_type_id string, field_name string, field_label string, data_type string, "
        "required boolean, aliases array<string>, allowed_values array<string>",
    )


def type_of(priority: Column) -> Column:
    out = None
    for name, type_id, _ in TYPES:
        hit = priority == name
        out = F.when(hit, type_id) if out is None else out.when(hit, type_id)
    return out


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def european(value: Column) -> Column:
    """Integer cents as ``1.234,56``."""
    whole = F.replace(F.format_number((value - F.pmod(value, F.lit(100))) / 100, 0), F.lit(","), F.lit("."))
    return F.concat(whole, F.lit(","), F.lpad(F.pmod(value, F.lit(100)).cast("string"), 2, "0"))


def plain(value: Column) -> Column:
    """Integer cents as ``1234.56``."""
    whole = ((value - F.pmod(value, F.lit(100))) / 100).cast("bigint").cast("string")
    return F.concat(whole, F.lit("."), F.lpad(F.pmod(value, F.lit(100)).cast("string"), 2, "0"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, invoice_type_id and the order columns the audit uses."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("doc_id"),
        type_of(F.col("o_orderpriority")).alias("invoice_type_id"),
        F.concat(F.lit("doc-"), F.col("o_orderkey"), F.lit(".pdf")).alias("invoice_file"),
        "o_custkey", "o_orderstatus", "o_orderdate", cents(F.col("o_totalprice")).alias("total_c"),
    )


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact integer sums per order (no floating-point order effects)."""
    li = read(spark, sf_dir, "lineitem")
    pct = F.round(F.col("l_discount") * 100).cast("bigint")
    tax = F.round(F.col("l_tax") * 100).cast("bigint")
    net = cents(F.col("l_extendedprice")) * (100 - pct)
    return li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.sum(net).alias("net_u"),
        F.sum(net * tax).alias("tax_u"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("units"),
        F.max(tax).alias("rate"),
    ).select(
        "doc_id", F.expr("(net_u + 50) div 100").alias("net_c"), F.expr("(tax_u + 5000) div 10000").alias("tax_c"),
        "units", "rate",
    )


def by_document(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows of documents dealt by doc_id, as many documents to a task as it can hold with all their fields and verdicts."""
    return dealt(rows, "doc_id", read(spark, sf_dir, "orders").count())


def dealt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_document(spark, sf_dir, documents(spark, sf_dir))


def wide_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their sums, dealt by doc_id; what is made of them meets other rows of a document in place."""
    sums = by_document(spark, sf_dir, measures(spark, sf_dir))
    return dealt_documents(spark, sf_dir).join(grown(sums), "doc_id", "left")


def field_results_of(wide: DataFrame, more: tuple[tuple[str, str, Column], ...] = ()) -> DataFrame:
    """Long field results of the wide documents (a narrow explode, no shuffle).

    ``more`` are further fields (id, name, text) of each document, on page one with confidence 0.5. Only texts are
    exploded: code that makes whole cells at once passes the 8,000 bytes up to which the JVM compiles a method.
    """
    k = F.col("doc_id")
    cust = F.col("o_custkey")
    status = F.col("o_orderstatus")
    date = F.col("o_orderdate")
    line_c = F.when(k % 4 == 0, F.col("units") * 800).when(k % 4 == 1, F.col("units") * 8).otherwise(F.col("units") * 8 + 7)
    texts = {
        "vendor_name": F.when(cust % 17 == 0, "").when(cust % 19 == 0, "null").otherwise(F.concat(F.lit("Customer#"), cust)),
        "invoice_number": F.when(k % 11 != 0, F.concat(F.lit("INV-"), k)),
        "invoice_date": F.when(k % 13 == 0, None).when(k % 3 == 0, F.date_format(date, "yyyy-MM-dd"))
                         .when(k % 3 == 1, F.date_format(date, "dd/MM/yyyy")).otherwise(F.date_format(date, "yyyy/MM/dd")),
        "currency": F.when(status == "F", "EUR").when(status == "O", F.when(k % 2 == 0, "usd ").otherwise("XAF")),
        "net_amount": european(F.col("net_c")),
        "tax_amount": plain(F.col("tax_c")),
        "gross_amount": european(F.when(k % 3 == 0, F.col("net_c") + F.col("tax_c")).otherwise(F.col("total_c"))),
        "vat_rate": F.when(k % 23 == 0, "%%%").otherwise(F.concat(F.col("rate").cast("string"), F.when(k % 2 == 0, "%").otherwise(""))),
        "units": F.col("units").cast("string"),
        "unit_rate": F.when(F.col("units").isNotNull(), "8"),
        "line_total": plain(line_c),
        "reverse_charge": F.when(cust % 2 == 0, "true").otherwise("false"),
    }
    listed = [(fid, name, texts[name]) for fid, name, *_rest in FIELDS] + list(more)
    rows = wide.select("doc_id", "invoice_type_id", F.posexplode(F.array(*[text for *_names, text in listed])).alias("_i", "value_text"))
    i = F.col("_i")

    def own(value: Column, other) -> Column:
        return F.when(i < len(FIELDS), value).otherwise(other) if more else value

    return rows.select(
        "doc_id", "invoice_type_id",
        F.get(F.array(*[F.lit(fid) for fid, *_rest in listed]), i).alias("field_id"),
        F.get(F.array(*[F.lit(name) for _fid, name, _text in listed]), i).alias("field_name"), "value_text",
        own(((k * 7 + i * 13) % 101) / 100.0, 0.5).alias("confidence"),
        own((1 + (k + i) % 3).cast("int"), 1).alias("source_page"),
        own((k + i) % 29 == 0, False).alias("flagged_for_review"),
    )


def field_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_results_of(wide_documents(spark, sf_dir))


def typed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field results whose decimals carry their number, as extraction leaves them."""
    decimals = [name for _, name, kind, *_ in FIELDS if kind == "decimal"]
    number = F.when(F.col("field_name").isin(decimals), rule_number(F.col("value_text")))
    return field_results(spark, sf_dir).withColumn("value_num", number)


def visual_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict per (labelled document, visual rule of its type)."""
    lab = read(spark, sf_dir, "labels").select(F.col("doc_id"), "quality", "toxic")
    visual = rules(spark).filter("check_type = 'visual_check'").select("rule_id", "invoice_type_id", "rule_order")
    rows = documents(spark, sf_dir).select("doc_id", "invoice_type_id").join(lab, "doc_id").join(
        visual, "invoice_type_id"
    )
    return rows.select(
        "doc_id", "invoice_type_id", "rule_id", "rule_order",
        (1 + F.col("doc_id") % 4).cast("int").alias("page_num"),
        (F.col("quality") == 1).alias("passes"),
        F.when(F.col("toxic") == 1, None).otherwise((F.col("doc_id") % 10) / 10.0).alias("confidence"),
        F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("Seen on page "), 1 + F.col("doc_id") % 4)).alias("observation"),
    )


#: Numbers of ``seq`` that two lines of an order span.
SEQ_SPAN = 1 << 53


def extraction_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts from line items; ``seq`` is the line position in its order."""
    li = read(spark, sf_dir, "lineitem")
    unread = (F.col("l_linestatus") == "F") & (F.col("l_quantity") < 10)
    seq = (F.col("l_linenumber").cast("bigint") * (1 << 28) + F.col("l_partkey")) * (1 << 24) + F.col("l_suppkey")
    return li.select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_returnflag").alias("field_name"),
        seq.alias("seq"),
        F.when(~unread, F.col("l_quantity").cast("bigint").cast("string")).alias("value_text"),
        (F.col("l_discount") * 10).alias("confidence"),
        F.col("l_linenumber").alias("source_page"),
    )


def raw_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attempts of every field and a third, in a second batch, of every third document."""
    names = F.array(*[F.lit(f[1]) for f in FIELDS])
    fr = field_results(spark, sf_dir).select("doc_id", "field_name", "value_text", (F.array_position(names, F.col("field_name")) - 1).alias("i"))
    k, i, j = F.col("doc_id"), F.col("i"), F.col("seq")
    tries = fr.withColumn("seq", F.explode(F.when(k % 3 == 0, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2)))))
    value = (
        F.when((j == 1) & ((k + i) % 4 != 0), F.concat(F.lit("<b>"), "value_text", F.lit("</b>")))
        .when((j == 2) & ((k + i) % 3 == 0), F.col("value_text")).when(j == 3, F.col("value_text"))
    )
    return tries.select(
        "doc_id", "field_name", F.col("seq").cast("bigint").alias("seq"), value.alias("value_text"),
        (((k * 7 + i * 13 + j * 31) % 101) / 100.0).alias("confidence"), (1 + (k + i + j) % 3).cast("int").alias("source_page"),
        F.concat(F.lit("r"), j).alias("source_region"), F.when(j == 3, 2).otherwise(1).alias("batch"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an execution log: run = user, sequence = event id."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "ts",
        F.col("event_type").alias("tool"), "value", "props", k.alias("k"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audit run per document."""
    d = documents(spark, sf_dir)
    k, c = F.col("doc_id"), F.col("o_custkey")
    drive = k % 3 == 0
    path = F.concat(F.lit("/in/"), "invoice_file")
    source_id = F.when(drive, F.concat(F.lit("gd"), k)).otherwise(path)
    states = F.array(*[F.lit(s) for s in ("passed", "passed", "failed", "needs_review", "interrupted", "running")])
    return d.select(
        "doc_id", F.concat(F.lit("run-"), k).alias("run_id"), F.concat(F.lit("doc-"), k).alias("invoice_id"),
        "invoice_file", path.alias("pdf_path"), F.when(drive, "google_drive").otherwise("local").alias("source_type"),
        source_id.alias("source_id"),
        F.when(drive, F.concat(F.lit("gdrive://"), source_id)).when(k % 2 == 0, F.concat(F.lit("file://"), path)).otherwise("").alias("source_uri"),
        F.substring(F.sha2(source_id, 256), 1, 12).alias("source_hash"), (k % 5).cast("string").alias("revision_id"),
        "invoice_type_id", F.element_at(states, (1 + c % 6).cast("int")).alias("agent_status"),
        F.when(c % 4 == 0, "").otherwise("done").alias("finish_reason"), (c % 30).cast("int").alias("turns_used"),
        F.when(k % 7 == 0, F.concat(F.lit("https://view/"), k)).alias("web_view_link"),
    )


def evidence(rule_results: DataFrame) -> DataFrame:
    """Evidence and policy references per (document, rule)."""
    k, r = F.col("doc_id"), F.col("rule_order")
    return rule_results.select(
        "doc_id", "rule_id",
        F.when(k % 20 == 0, "no supplier seen").when(k % 10 == 0, "p2: supplier quotation")
         .when(r % 2 == 0, F.concat(F.lit("p"), 1 + k % 3, F.lit(":totals"))).otherwise("").alias("evidence_refs"),
        F.when(r % 4 == 0, F.concat(F.lit('{"snippet_id": "L'), F.lpad((k % 50).cast("string"), 3, "0"), F.lit('", "source": "learnings"}')))
         .when(r % 4 == 1, F.concat(F.lit('{"snippet_id": "'), "rule_id", F.lit('", "source": "rules"}; see '), "rule_id", F.lit(" page 2")))
         .when(r % 4 == 2, F.lit('{"title": "Guide", "snippet_id": "S1"}')).otherwise("").alias("policy_refs"),
    )


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per (order, line number) with a category and a description."""
    li = read(spark, sf_dir, "lineitem")
    per_page = li.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_num")).agg(
        F.max(cents(F.col("l_extendedprice"))).alias("price_c"), F.min("l_shipdate").alias("day"), F.max("l_partkey").alias("part"))
    k, n = F.col("doc_id"), F.col("page_num")
    kinds = F.array(*[F.lit(w) for w in ("Invoice", "Receipt of bank transfer", "Nomina", "Stamp", "Annex")])
    shared = (k % 90) * 100 + F.when(F.col("part") % 3 == 0, n * 2).otherwise(n * 700)
    ref = F.when(F.col("part") % 2 == 0, F.concat(F.lit(" ref AB-"), F.lpad((k % 1000).cast("string"), 4, "1"))).otherwise("")
    date = F.when(F.col("part") % 5 < 3, F.concat(F.lit(" on "), F.lpad((1 + k % 28).cast("string"), 2, "0"), F.lit("/05/2024"))).otherwise(
        F.concat(F.lit(" on 2024-05-"), F.lpad((1 + k % 28).cast("string"), 2, "0")))
    return per_page.select(
        "doc_id", "page_num",
        F.element_at(F.array(*[F.lit(c) for c in ("INVOICE_HEADER", "LINE_ITEMS", "TOTALS", "SIGNATURE_STAMP", "SUPPORTING_DOC", "COVER_PAGE", "BLANK", "UNKNOWN")]),
                     (1 + (k + n) % 8).cast("int")).alias("category"),
        F.concat(F.element_at(kinds, (1 + F.col("part") % 5).cast("int")), F.lit(" total "), european(F.col("price_c")), F.lit(" fee "),
                 plain(shared), ref, date).alias("description"),
        "price_c", "part",
    )


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three positioned lines per page row, all on page one of the document."""
    p = page_rows(spark, sf_dir).select("doc_id", "page_num", "price_c", "part")
    types = documents(spark, sf_dir).select("doc_id", "invoice_type_id")
    n, part, k = F.col("page_num"), F.col("part"), F.col("doc_id")
    heads = F.array(F.concat(F.lit("Net amount: "), european(F.col("price_c"))), F.lit("Tax amount"), F.lit("Gross Total"),
                    F.concat(F.lit("Invoice Date : "), 1 + part % 28), F.lit("VAT rate:"), F.concat(F.lit("Véndor name "), part), F.lit("Importe"))
    bodies = (F.element_at(heads, n), european(F.col("price_c")), F.concat(F.lit("note "), part))
    cells = []
    for i, body in enumerate(bodies):
        x1 = 50 + (part % 5) * 60 + (i * 200 if i == 2 else 0)
        y1 = n * 90 + i * 28
        cells.append(F.struct(
            (n * 3 + i).alias("line_no"), body.alias("text"), ((k + n * 3 + i) * 7 % 100 / 100.0).alias("confidence"),
            x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), (x1 + 120 + i * 40).cast("int").alias("x2"),
            (y1 + 20).cast("int").alias("y2")))
    # Types are met by the page rows: their lines would travel three times as many, with texts and boxes.
    return p.join(grown(types), "doc_id").select("doc_id", "invoice_type_id", F.explode(F.array(*cells)).alias("_l")).select(
        "doc_id", F.lit(1).alias("page_num"), "_l.*", F.lit(600).alias("image_width"), F.lit(800).alias("image_height"), "invoice_type_id"
    )


def learning_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as learning lines; every fifth is general."""
    b = read(spark, sf_dir, "benchmark")
    k = F.col("item_id")
    scope = F.element_at(F.array(F.lit("GENERAL"), *[F.lit(t[1]) for t in TYPES[:4]]), (1 + k % 5).cast("int"))
    shorts = F.array(*[F.lit(t[2]) for t in TYPES])
    mention = F.when(k % 3 == 0, F.concat(F.lit(" see R_"), F.element_at(shorts, (1 + k % 5).cast("int")), F.lit("_00"), 1 + k % 9)).otherwise(
        F.when(k % 3 == 1, F.lit(" about currency and VENDOR stamp")).otherwise(""))
    return b.select(
        scope.alias("invoice_type_id"), k.alias("line_no"),
        F.concat(F.lit("- [L"), F.lpad(k.cast("string"), 3, "0"), F.lit("] [2024-01-01] "), F.regexp_replace("text", r"\s+", " "), mention).alias("text"))
