"""Schemas of the engine's tables."""

LINE = "file_id string, page_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, angle double, score double"
REGION_LINE = LINE + ", region_no int, crop_id string"
ROW = "file_id string, page_no int, region_no int, row_no int, text string, x0 double, y0 double, x1 double, y1 double"
RECORD = (
    "record_id string, ord struct<file_id:string,page_no:int,region_no:int,part:int>, file_id string, page_no int, region_no int, source_file string, source string, invoice_type string, doc_kind string, "
    "invoice_date string, date_candidates array<string>, currency string, subtotal decimal(18,2), tax decimal(18,2), tip decimal(18,2), total_incl_tax decimal(18,2), "
    "printed_total decimal(18,2), confidence string, notes array<string>, total_src string, moneyish boolean, slip_verified boolean, error string, crop_id string"
)
REVIEW_EVENT = "record_id string, seq long, date string, amount decimal(18,2), confirmed boolean, deleted boolean"
