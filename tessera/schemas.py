"""Explicit schemas, as DDL strings; nothing is inferred from data."""

REQUEST = (
    "id string, "
    "transaction struct<amount: float, installments: float, requested_at: string>, "
    "customer struct<avg_amount: float, tx_count_24h: float, known_merchants: array<string>>, "
    "merchant struct<id: string, mcc: string, avg_amount: float>, "
    "terminal struct<is_online: boolean, card_present: boolean, km_from_home: float>, "
    "last_transaction struct<timestamp: string, km_from_current: float>"
)
REFERENCE = ("vector array<float>, label string")
SAMPLE = (
    "seq bigint, recv_ns bigint, json_ns bigint, knn_ns bigint, send_ns bigint, total_ns bigint, "
    "clusters_probed int, vectors_scanned int, repair_triggered int, early_exit_taken int"
)
