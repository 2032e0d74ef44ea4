"""Composed delivery messages from the orders table; the same SQL text runs on Spark and in the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import tasks_for

#: Messages that one task makes and parses: seconds of work, however many there are.
TASK_MESSAGES = 50_000


def _pick(words: str, index: str) -> str:
    return f"split_part('{words}', '|', cast({index} as int) + 1)"


def _phone(k: str) -> str:
    return f"'0' || {_pick('3|5|7|8|9', f'({k}) % 5')} || lpad(cast((({k}) * 7919 + 12345) % 100000000 as varchar(20)), 8, '0')"


PARTS = f"""
select o_orderkey as message_id, o_orderkey as k, cast(o_orderkey % 12 as int) as v,
  {_phone("o_orderkey")} as phone, {_phone("o_orderkey + 1")} as phone2,
  {_pick("Nguyễn Văn|Trần Thị|Lê Minh|Phạm Thu|Hoàng Văn|Vũ Thị|Đặng Minh|Bùi Thu", "o_orderkey % 8")} || ' ' ||
  {_pick("An|Bình|Hoa|Hùng|Khoa|Lan|Mai|Nam|Trang|Tùng", "o_orderkey % 10")} as name,
  cast(o_orderkey % 300 + 1 as varchar(20)) || ' ' || {_pick("Lê Lợi|Nguyễn Huệ|Hai Bà Trưng|Trần Phú|Nguyễn Du|Lý Tự Trọng|Võ Thị Sáu", "o_orderkey % 7")}
  || ' ' || {_pick("Q1 HCM|Q3 HCM|Đống Đa Hà Nội|Thanh Xuân Hà Nội", "o_orderkey % 4")} as addr,
  {_pick("giao buổi sáng|gọi trước 30p|hàng dễ vỡ|giao sau 5h chiều", "o_orderkey % 4")} as note
from orders
"""

MESSAGES = f"""
select *, case
  when k % 97 = 0 then '   ' when k % 89 = 0 then repeat('a', 5001)
  when v = 0 then name || ', ' || phone || ', ' || addr || ', ' || note
  when v = 1 then 'Tên: ' || name || ' | ĐT: ' || phone || ' | Địa chỉ: ' || addr || ' | Ghi chú: ' || note
  when v = 2 then name || chr(10) || phone || chr(10) || addr
  when v = 3 then name || ', ' || substr(phone, 1, 4) || ' ' || substr(phone, 5, 3) || ' ' || substr(phone, 8, 3) || ', ' || addr
  when v = 4 then name || ', +84' || substr(phone, 2, 9) || ', ' || addr
  when v = 5 then name || ', (' || substr(phone, 1, 4) || ') ' || substr(phone, 5, 3) || '.' || substr(phone, 8, 3) || ', ' || addr
  when v = 6 then 'giao tới ' || addr || ', liên hệ ' || substr(phone, 1, 9)
  when v = 7 then name || ', 0123456' || lpad(cast(k % 1000 as varchar(20)), 3, '0') || ', ' || addr
  when v = 8 then 'mã đơn: ' || phone || ', ship tới ' || addr
  when v = 9 then name || ' ' || phone || ', liên hệ shop ' || phone2 || ', giao tới ' || addr
  when v = 10 then '<script>alert(1)</script>' || chr(1) || ' ship tới ' || addr
  else 'tên ' || name || ', sdt ' || phone end as text
from ({PARTS}) parts
"""


def dealt_keys(spark: SparkSession, sf_dir: str, each: int, *by: str) -> DataFrame:
    """o_orderkey of every order, `each` of them a task (dealt out by the columns `by`, if any)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey").repartition(tasks_for(spark, orders.count(), each), *by)  # counted from the file's footers


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """message_id, text and the composing values k, v, phone, phone2, name, addr, note."""
    # Keys are dealt out before texts are made of them: a small file is one split, and parsing is the work.
    return spark.sql(MESSAGES.replace("from orders", "from {orders}"), orders=dealt_keys(spark, sf_dir, TASK_MESSAGES))
