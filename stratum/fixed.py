"""Values that results depend on; all are fixed."""

from __future__ import annotations

# Names, patterns, vocabularies, messages.
COLUMN_MAPPING = {
    "InvoiceNo": "invoice_no",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_date",
    "UnitPrice": "unit_price",
    "CustomerID": "customer_id",
    "Country": "country",
}
STRING_COLUMNS = ("InvoiceNo", "StockCode", "CustomerID")
REASON_CANCELLED = "取消订单 (InvoiceNo以C开头)"
REASON_NO_CUSTOMER = "CustomerID 为空"
REASON_QUANTITY = "Quantity ≤ 0"
REASON_PRICE = "UnitPrice ≤ 0"
SENTINELS = (-9999, -999, -99, 9999, 99999, 999, 32767, -32768)
DATE_NAME = r"(?i)(^date$|_date$|^dt$|_dt$|_time$|^time$|timestamp|created_at|updated_at|^day$|_day$|^month$|_month$|^year$|_year$)"
ID_NAME = r"(?i)(^id$|_id$|_key$|_pk$|^pk$|uuid|guid|identifier|serial)"
DATE_TEXT = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4}"
BOOL_SETS = ({"yes", "no"}, {"true", "false"}, {"y", "n"}, {"0", "1"}, {"t", "f"})
SEPARATORS = (",", "\t", ";", "|")
BOMS = {b"\xef\xbb\xbf": "utf-8", b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}
TRIAL_ENCODINGS = ("utf-8", "cp1252", "latin-1")
TAIL_ROW = r"(?i)^\s*(total|sum|合计|總計|汇总|平均值|average|count)\s*[:：]?\s*[\d,.]*\s*$"
CURRENCY = "$€£¥₹"
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
SUMMARY_EMPTY = "无数据"
SUMMARY_NAMES = {
    "days": "统计天数",
    "sales": "累计销售额",
    "orders": "累计订单数",
    "customers": "累计客户数",
    "mean_sales": "日均销售额",
    "order_value": "平均客单价",
    "most_sales": "最高单日销售额",
    "most_orders": "最高单日订单数",
}
REPORT_TITLE = "订单数据日报 — 生成时间"
IDENTIFIER = r"[a-zA-Z_][a-zA-Z0-9_]*"
QUALITY_CRITICAL = ("invoice_no", "quantity", "invoice_date", "unit_price")
QUALITY_RATES = ("description", "stock_code", "country")
NULL_RATE_THRESHOLD = 0.30
