"""Small hand-built ledgers."""

COLUMNS = (
    "sig long, slot long, ts long, fee_payer string, source string, dest string, amount long, kind string, "
    "operator long, pos long"
)


def ledger(spark, *rows):
    """Rows (sig, slot, ts, source, dest, amount[, operator[, fee_payer]]); each has a fee payer of its own by default."""
    full = []
    for pos, r in enumerate(rows):
        sig, slot, ts, source, dest, amount, *rest = r
        operator = rest[0] if rest else None
        payer = rest[1] if len(rest) > 1 else f"p{200 + sig}"
        full.append((sig, slot, ts, payer, source, dest, amount, "transfer", operator, pos))
    return spark.createDataFrame(full, COLUMNS)


def same(clusters, *names):
    """Whether the accounts are in one cluster."""
    of = {r["account"]: r["cluster_id"] for r in clusters.collect()}
    return len({of[n] for n in names}) == 1
