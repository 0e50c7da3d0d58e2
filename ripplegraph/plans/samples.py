"""Small code bases and diffs as literals, for queries over sources; all invented."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDERS = '''import requests
from flask import Flask
app = Flask(__name__)
BASE = "http://stock.example.org"
ITEMS = BASE + "/v1/items"

def tax(amount):
    rate = amount * 2
    return rate

@app.route("/v1/orders", methods=["POST"])
def create(order):
    total = tax(order)
    reply = requests.get(ITEMS)
    if total:
        final = total + 1
    return final

async def later(order):
    due = tax(order)
    return due
'''
STOCK = '''from orders import tax

class Stock:
    def price(self, item):
        base = item * 3
        cost = tax(base)
        for part in cost:
            last = part
        return cost

@app.route("/v1/items")
def items():
    return []
'''
BROKEN = "def broken(:\n    pass\n"
SHOP = '''const list = async (req, res) => {
  const url = "http://orders.example.org/v1/orders";
  return fetch(url);
};
function pay(order, total) {
  if (order) { return total; }
  return 0;
}
const handler = pay;
app.get("/shop/list", list);
const routes = [
  { path: `${base}/shop/pay`, handler: pay },
  { handler: 'list', route: '/shop/all' },
];
'''
CONFIG = '{"services": {"ITEMS_URL": "http://stock.example.org/v1/items", "deep": {"list": ["https://a.example.org/x", {"LAST": "http://b.example.org/y"}]}}}'
YAML = "service:\n  url: http://orders.example.org/v1/orders\n  others:\n    - https://c.example.org/z\n"
DIFF = """Output of git diff in /src/shop/:
diff --git a/orders.py b/orders.py
index 1111111..2222222 100644
--- a/orders.py
+++ b/orders.py
@@ -7,3 +7,4 @@ def tax(amount):
 def tax(amount):
-    rate = amount * 2
+    rate = amount * 3
+    rate += 1
     return rate
@@ -20 +21 @@ async def later(order):
-    due = tax(order)
+    due = tax(order) --1
diff --git a/notes.txt b/notes.txt
--- a/notes.txt
+++ b/notes.txt
@@ -1,1 +1,1 @@
-old
+new
diff --git a/stock.py b/stock.py
--- a/stock.py
+++ b/stock.py
@@ -5,2 +5,2 @@ class Stock:
-        base = item * 3
+        base = item * 4
         cost = tax(base)
"""


def code_base(spark: SparkSession) -> DataFrame:
    """files(service, lang, path, content)."""
    rows = [("orders", "python", "orders.py", ORDERS), ("stock", "python", "stock.py", STOCK), ("stock", "python", "broken.py", BROKEN), ("shop", "javascript", "shop.js", SHOP), ("shop", "json", "config.json", CONFIG), ("shop", "yaml", "config.yml", YAML)]
    return spark.createDataFrame(rows, "service string, lang string, path string, content string")


def python_files(spark: SparkSession) -> DataFrame:
    return code_base(spark).where("lang = 'python'")


def script_files(spark: SparkSession) -> DataFrame:
    return code_base(spark).where("lang = 'javascript'")


def diff(spark: SparkSession) -> DataFrame:
    """diff_lines(source, lineno, line)."""
    return spark.createDataFrame([("sample", k, t) for k, t in enumerate(DIFF.split("\n"), 1)], "source string, lineno int, line string")
