"""Small tables given in the code, as DataFrames and as SQL, for operators whose inputs the test tables don't hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# name: (columns, rows)
TABLES: dict[str, tuple[str, list[tuple]]] = {
    "fx_code": (
        "chunk_id long, ext string, text string",
        [
            (1, ".java", "package com.shop.order;\nimport com.shop.user.UserRepository;\nimport com.shop.pay.PayClient;\n@Service\npublic class OrderService extends BaseService implements Auditable, Closeable {\n  @Autowired\n  private UserRepository users;\n  private PayClient pay = new PayClient();\n  public Order load(String id) { return null; }\n}"),
            (2, ".java", '@RestController\n@RequestMapping("/api/v1/orders")\npublic class OrderController {\n  @GetMapping("/list")\n  public String list() { return ""; }\n  @PostMapping("/new")\n  public String create() { return ""; }\n}'),
            (3, ".java", "public interface Ledger extends Book<Entry>, Store {\n  private OrderService orders;\n  private List<Order> rows;\n}"),
            (4, ".py", "import os\nfrom pathlib import Path\nfrom json import dumps\nimport os\n\ndef handle_approval(self):\n    return 1\n\nclass Handler:\n    pass"),
            (5, ".vue", "import Vue from 'vue'\nimport { Button } from './ui/Button.vue'\nconst fs = require('fs')"),
            (6, ".xml", "<dependency>\n <groupId>org.spark</groupId>\n <artifactId>core</artifactId>\n</dependency><dependency><groupId>org.arrow</groupId><artifactId>arrow</artifactId></dependency>"),
            (7, ".yaml", "url: ${db.url}\nuser: ${db.user.name}\nplain: ${nothing}"),
            (8, ".md", "# Title\n\nSome text that is rather short."),
            (9, ".log", "2024-01-01 10:00:00 started"),
            (10, ".png", "x"),
            (11, "", "INFO started\nERROR failed\nWARN odd"),
            (12, "", "host: localhost\nport: 8080"),
            (13, ".txt", ""),
        ],
    ),
    "fx_names": ("name string", [(x,) for x in ("KYC", "kyc认证", "ValueObject", "AuditServiceImpl", "AuditService", "OrderDTO", "Repository", "order", "orders", "OrderService", "x", "", "data", "api", "用户", "a" * 81, "___", "!!", "12.5%", "HTTP", "token_store", "Cache", "K6_RUN", "ABCDEFG", "http://x", "UserInfo", "config")]),
    "fx_detections": (
        "name string, type string, mode string, found boolean, seq long",
        [("alpha", "class", m, True, i) for i, m in enumerate(("regex", "hybrid-7b", "hybrid-1.5b", "7b"))] + [("beta", "api", m, True, i + 10) for i, m in enumerate(("regex", "hybrid-7b", "hybrid-1.5b"))] + [("gamma", "concept", "regex", True, 20), ("gamma", "class", "7b", False, 21), ("delta", "module", "1.5b", True, 30), ("delta", "module", "1.5b", True, 31), ("eps", "class", "gpt-4o-mini", False, 40), ("zeta", "function", "unknown", True, 50)],
    ),
    "fx_entities": (
        "id long, name string, type string, mode string, status string, wing string, created_at string",
        [
            (1, "OrderService", "class", "regex", None, "shop", "2023-01-01 00:00:00"), (2, "trade", "concept", "1.5b", None, "bank", "2023-01-01 00:00:00"), (3, "order", "function", "7b", None, "shop", "2023-01-01 00:00:00"),
            (4, "订单", "class", "regex", None, "shop", "2024-01-20 00:00:00"), (5, "auth", "concept", "1.5b", "pruned", "shop", "2023-05-01 00:00:00"), (6, "Authentication", "module", "7b", None, "bank", "2023-05-01 00:00:00"),
            (7, "logger", "concept", "1.5b", None, "shop", "2023-05-01 00:00:00"), (8, "abc", "concept", "7b", None, "shop", "2024-01-30 00:00:00"), (9, "3.14", "concept", "regex", None, "shop", "2023-01-01 00:00:00"), (10, "Lonely", "class", "regex", None, "shop", "2023-01-01 00:00:00"), (11, "Fresh", "class", "regex", None, "shop", "2024-01-29 00:00:00"), (12, "a_b1", "concept", "regex", None, "shop", "2023-01-01 00:00:00"),
        ],
    ),
    "fx_links": ("entity_id long, chunk_id long, relevance double", [(1, 100, 1.0), (1, 101, 0.5), (2, 100, 0.9), (3, 102, 0.8), (4, 100, 0.7), (4, 103, 0.2), (5, 104, 0.6), (6, 104, 1.0), (7, 100, 0.9), (8, 105, 0.4), (12, 106, 0.6)]),
    "fx_relations": ("source_id long, target_id long, type string, weight double", [(1, 2, "uses", 1.0), (1, 3, "uses", 0.5), (2, 3, "calls", 0.7), (3, 3, "calls", 0.7), (4, 1, "extends", 1.0), (5, 6, "is_a", 0.9), (2, 4, "calls", 0.3)]),
    "fx_existing": ("name string, type string, mode string", [("alpha", "class", "7b"), ("beta", "api", "regex"), ("gamma", "concept", "1.5b")]),
    "fx_incoming": ("name string, type string, mode string", [("alpha", "module", "regex"), ("beta", "class", "regex"), ("delta", "class", "odd")]),
    "fx_models": (
        "name string, intelligence string, cost_tier string, speed_tier string, avg_latency_ms double, oscillating boolean, healthy boolean",
        [("small", "low", "free", "fast", 60.0, False, True), ("middle", "medium", "low", "medium", None, False, True), ("large", "high", "medium", "slow", 4000.0, False, True), ("best", "very_high", "high", "slow", 6000.0, False, True), ("shaky", "very_high", "free", "fast", 20.0, True, True), ("down", "high", "free", "fast", 30.0, False, False)],
    ),
    "fx_health": ("name string, latency_ms double", [("small", 80.0), ("middle", 400.0), ("large", 2500.0)]),
    "fx_capabilities": (
        "capability string, min_intelligence string, max_cost string, max_latency_ms double, objective string, candidates array<string>",
        [("bulk", "low", "low", None, "speed", ["small", "middle", "shaky", "down"]), ("deep", "high", "high", 9000.0, "quality", ["large", "best", "middle"]), ("cheap", "medium", "high", None, "cost", ["best", "large", "middle"]), ("hard", "very_high", "medium", 3000.0, "quality", ["small", "large", "best", "nobody"]), ("free", None, None, None, "speed", ["middle", "small"]), ("none", "very_high", "free", 10.0, "speed", ["small"])],
    ),
    "fx_answers": ("id long, raw string", [(1, '{"entities":[{"name":"Alpha","type":"class"},{"name":"data","type":"concept"}],"relations":[{"source":"Alpha","target":"Beta","type":"uses"}]}'), (2, '```json\n{"entities":[{"name":"beta_x","type":"api"}]}\n```'), (3, 'Sure: {"entities":[{"name":"Gamma","type":"concept"},{"name":"v","type":"variable"},{"name":"vv","type":"variable"}]} done'), (4, '{"entities":[{"name"'), (5, ""), (6, "no json")]),
    "fx_scores": ("id long, raw string, n long", [(1, '{"scores":[8,5.5]}', 3), (2, 'x {"scores": [10, 0, 3, 4]} y', 2), (3, "broken", 2), (4, '{"scores":[]}', 1)]),
    "fx_facts": ("fact_id long, fact_text string, valid_from string, valid_to string", [(1, "a", "2024-01-01 00:00:00", "2024-01-10 00:00:00"), (2, "b", "2024-01-05 00:00:00", None), (3, "c", "2024-01-10 00:00:00", None)]),
    "fx_paths": ("path string", [(x,) for x in ("", "agent-1f2e/x.json", "notes.md", "skills/search/readme.md", "docs/a/b.py", "04-adr/x.md", "learning/x", "shop/order/Order.JAVA", ".hidden", "a/b.tar.gz", "a.b/c", "x.MD", "y.yaml", "z.log", "q.sql")]),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    columns, rows = TABLES[name]
    return spark.createDataFrame(rows, columns)


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) if isinstance(x, int) else f"{x!r}::DOUBLE"


_sql = {"long": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "array<string>": "VARCHAR[]"}


def values(columns: str, rows: list[tuple]) -> str:
    """Rows as a SELECT."""
    parts = [c.split() for c in columns.split(", ")]
    cast = ", ".join(f"CAST({c} AS {_sql[t]}) AS {c}" for c, t in parts)
    return f"SELECT {cast} FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") AS t({', '.join(c for c, _ in parts)})"


def cte(*names: str) -> str:
    """WITH entries that hold the fixtures."""
    return ",\n".join(f"{name} AS ({values(*TABLES[name])})" for name in names)
