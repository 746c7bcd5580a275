"""Rows that some queries over small tables gave when they were written, read through against the rules then.

They guard against change. They were taken from the queries' own output, so they are no independent proof; where one can
be stated in SQL, oracle_sql() has it (for relations and graph building over a whole corpus: relations_corpus and others).
"""

import pytest

from tessella.plans import graph, operations

QUERIES = graph.QUERIES | operations.QUERIES

# name: (columns, rows)
ROWS = {
    "relations_code": (
        "chunk_id long, source string, target string, type string, weight double",
        [
            (1, "OrderService", "Auditable", "implements", 1.0), (1, "OrderService", "BaseService", "extends", 1.0),
            (1, "OrderService", "Closeable", "implements", 1.0), (1, "OrderService", "service", "is_a", 0.9),
            (1, "PayClient", "pay", "has_field", 0.7), (1, "PayClient", "pay", "imports", 0.6), (1, "UserRepository", "user", "imports", 0.6),
            (1, "UserRepository", "users", "depends_on", 1.0), (1, "UserRepository", "users", "has_field", 0.7),
            (2, "/api/v1/orders/api/v1/orders", "REQUEST", "serves_path", 1.0), (2, "/api/v1/orders/list", "GET", "serves_path", 1.0),
            (2, "/api/v1/orders/new", "POST", "serves_path", 1.0), (3, "Ledger", "Book", "extends", 1.0), (3, "Ledger", "Store", "extends", 1.0),
            (3, "OrderService", "orders", "has_field", 0.7), (4, "Path", "pathlib", "imports", 0.5), (4, "dumps", "json", "imports", 0.5),
            (4, "os", "os", "imports", 0.5), (5, "Button", "", "imports", 0.5), (5, "from", "", "imports", 0.5),
            (6, "arrow", "org.arrow", "depends_on", 0.8), (6, "core", "org.spark", "depends_on", 0.8), (7, "db.url", "config", "configures", 0.4),
            (7, "db.user.name", "config", "configures", 0.4),
        ],
    ),
    "relations_python": (
        "chunk_id long, source string, target string, weight double",
        [
            (4, "Path", "pathlib", 0.5), (4, "dumps", "json", 0.5), (4, "os", "os", 0.5),
        ],
    ),
    "fuzzy_scan": (
        "name string, other string, score double",
        [
            ("AuditService", "AuditServiceImpl", 0.9), ("KYC", "kyc认证", 1.0), ("order", "OrderDTO", 0.98), ("order", "OrderService", 1.22),
            ("order", "orders", 0.86), ("orders", "OrderService", 1.1), ("orders", "order", 0.86),
        ],
    ),
    "graph_build": (
        "name string, type string, chunks long, outgoing long",
        [
            ("./ui/Button.vue", "module", 1, 0), ("/api/v1/orders", "api", 1, 0), ("/api/v1/orders/api/v1/orders", "class", 0, 1),
            ("/api/v1/orders/list", "class", 0, 1), ("/api/v1/orders/new", "class", 0, 1), ("/list", "api", 1, 0), ("/new", "api", 1, 0),
            ("Auditable", "module", 0, 0), ("BaseService", "module", 0, 0), ("Book", "module", 0, 0), ("Closeable", "module", 0, 0),
            ("GET", "module", 0, 0), ("Handler", "class", 1, 0), ("Ledger", "class", 0, 2), ("OrderController", "class", 1, 0),
            ("OrderService", "class", 1, 5), ("POST", "module", 0, 0), ("Path", "class", 0, 1), ("PayClient", "class", 0, 2),
            ("REQUEST", "module", 0, 0), ("Store", "module", 0, 0), ("UserRepository", "class", 0, 3), ("arrow", "class", 0, 1),
            ("com.shop.order", "module", 1, 0), ("core", "class", 0, 1), ("create", "function", 1, 0), ("dumps", "class", 0, 1),
            ("fs", "variable", 1, 0), ("handle_approval", "function", 1, 0), ("json", "module", 0, 0), ("list", "function", 1, 0),
            ("load", "function", 1, 0), ("orders", "module", 0, 0), ("org.arrow", "module", 0, 0), ("org.spark", "module", 0, 0),
            ("os", "class", 0, 1), ("pathlib", "module", 0, 0), ("pay", "variable", 1, 0), ("service", "module", 0, 0), ("user", "module", 0, 0),
            ("users", "module", 0, 0), ("vue", "module", 1, 0),
        ],
    ),
    "probe_extractor": (
        "model string, accuracy double, intelligence string, avg_latency_ms double, speed_tier string",
        [
            ("regex", 0.833333, "very_high", 6.0, "fast"),
        ],
    ),
}


@pytest.mark.parametrize("name", ROWS)
def test_as_before(spark, name):
    columns, rows = ROWS[name]
    names = [c.split()[0] for c in columns.split(", ")]
    got = [tuple(r) for r in QUERIES[name](spark, "").select(names).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)
