"""Schemas and small makers shared by the test modules."""
import datetime as dt


def d(y, m, day):
    return dt.datetime(y, m, day)


SALES_SCHEMA = ("tanggal timestamp_ntz, category string, status string, product_id bigint, "
                "items bigint, gross_sales decimal(22,2), profit decimal(28,4)")
ORDERS_SCHEMA = "tanggal timestamp_ntz, status string, orders bigint"
EVENTS_SCHEMA = "tanggal timestamp_ntz, event_type string, traffic_source string, sessions bigint"
DIM_SCHEMA = "product_id bigint, product_name string, brand string"
PAIRS_SCHEMA = "kat1 string, kat2 string, n bigint"
