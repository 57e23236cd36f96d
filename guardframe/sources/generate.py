"""Synthetic users, transactions and logs of any size.

Every choice is a function of the row's id, so a lost partition is made again with the same rows.
The number of rows is that of the ids given: ``spark.range(n)`` or a key column of a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardframe.functions.text import iso_utc, text_array
from guardframe.sources.seeds import (
    CORE_LOGS,
    CORE_TRANSACTIONS,
    CORE_USERS,
    LOGS_SCHEMA,
    TRANSACTIONS_SCHEMA,
    USERS_SCHEMA,
)

FIRST_NAMES = ["Ada", "Ben", "Clara", "Dario", "Edith", "Farid", "Greta", "Hugo", "Iris", "Jonas",
               "Katya", "Luis", "Mira", "Nils", "Olga", "Pablo"]
LAST_NAMES = ["Abbot", "Berger", "Castell", "Dubois", "Eriksen", "Farkas", "Gruber", "Hansen",
              "Ivanov", "Jansen", "Keller", "Lindqvist", "Moreau"]
DOMAINS = ["example.com", "example.org", "example.net", "mail.example.com", "shop.example.org"]
PRODUCTS = [("Bench vise", 89.5), ("Canvas tent", 249.0), ("Desk lamp", 34.9),
            ("Espresso machine", 612.0), ("Field recorder", 199.0), ("Gravel bike", 1890.0),
            ("Handheld radio", 75.0), ("Induction hob", 330.0), ("Jigsaw", 120.0),
            ("Kayak", 980.0), ("Laser level", 149.0)]
# repeated entries are likelier
ROLES = ["customer", "customer", "customer", "customer", "admin", "operator"]
STATUSES = ["active", "active", "active", "active", "suspended"]
LOG_LEVELS = ["INFO", "INFO", "INFO", "WARNING", "ERROR"]
TRANSACTION_STATUSES = ["completed", "completed", "completed", "completed", "failed"]
LOG_MESSAGES = ["Query finished.", "User signed in.", "Session refreshed.", "Backup written.",
                "Index rebuilt.", "Heartbeat received.", "Scan found nothing.",
                "Settings changed.", "Response redacted.", "Slow query seen.",
                "Repeated sign-in failures."]

def pick(row: str, salt: int, n: int) -> Column:
    """A number from 0 to ``n - 1`` that depends on the row and the salt only.

    The first sixty bits of a digest, so that any ``n`` and any number of rows are served evenly.
    ``row`` names a column of integers; one SQL text makes the plan quicker to build than columns.
    """
    digits = f"substring(md5(concat(cast(`{row}` as string), ':{salt}')), 1, 15)"
    return F.expr(f"cast(conv({digits}, 16, 10) as bigint) % {n}L")


def choice(row: str, salt: int, values: list) -> Column:
    if isinstance(values[0], str):
        options = text_array(values)
    else:
        options = F.expr("array(" + ", ".join(f"{value!r}D" for value in values) + ")")
    return F.get(options, pick(row, salt, len(values)).cast("int"))


def _number(row: str, salt: int, low: int, high: int) -> Column:
    return (pick(row, salt, high - low + 1) + low).cast("string")


def _time_before(row: str, salt: int, base: Column) -> Column:
    """ISO text of a time up to 30 days, 23 hours and 59 minutes before ``base``."""
    back = F.make_interval(
        days=pick(row, salt, 31).cast("int"),
        hours=pick(row, salt + 1, 24).cast("int"),
        mins=pick(row, salt + 2, 60).cast("int"),
    )
    return iso_utc(base - back)


def _user_columns(row: str) -> list[Column]:
    first, last = choice(row, 1, FIRST_NAMES), choice(row, 2, LAST_NAMES)
    return [
        F.concat(F.lit("usr_"), (F.col(row) + 10000).cast("string")).alias("user_id"),
        F.concat_ws(" ", first, last).alias("name"),
        F.concat(F.lower(F.substring(first, 1, 3)), F.lower(last), F.lit("@"),
                 choice(row, 3, DOMAINS)).alias("email"),
        F.concat(F.lit("("), _number(row, 4, 200, 999), F.lit(") 555-"), _number(row, 5, 100, 999),
                 F.lit("-"), _number(row, 6, 1000, 9999)).alias("phone"),
        F.concat_ws("-", _number(row, 7, 100, 999), _number(row, 8, 10, 99),
                    _number(row, 9, 1000, 9999)).alias("ssn"),
        F.concat_ws("-", _number(row, 10, 4000, 4999),
                    *[_number(row, salt, 1000, 9999) for salt in (11, 12, 13)]).alias("credit_card"),
        F.concat(F.lit("$2b$12$"), F.substring(F.sha2(F.col(row).cast("string"), 256), 1, 53))
        .alias("password_hash"),
        ((pick(row, 14, 18510001) - 10000) / 100.0).alias("account_balance"),
        choice(row, 15, ROLES).alias("role"),
        choice(row, 16, STATUSES).alias("status"),
    ]


def gen_users(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The core users and one generated user per id."""
    core = ids.sparkSession.createDataFrame(CORE_USERS, USERS_SCHEMA)
    return core.unionByName(ids.select(*_user_columns(id_col)))


def gen_transactions(ids: DataFrame, n_users: int, base: Column, id_col: str = "id") -> DataFrame:
    """The core transactions and one per id, each with the id and card of a random user.

    The users are those of ``gen_users(spark.range(n_users))``, core users first. Which user a
    transaction names is a number, and a generated user's fields follow from that number, so no
    join is needed.
    """
    n_core = len(CORE_USERS)
    drawn = ids.select(id_col, (pick(id_col, 21, n_users + n_core) - n_core).alias("_user"))
    names = [part.split()[0] for part in USERS_SCHEMA.split(",")]
    columns = dict(zip(names, _user_columns("_user")))

    def copied(name: str) -> Column:
        core = text_array([values[names.index(name)] for values in CORE_USERS])
        from_core = F.get(core, (F.col("_user") + n_core).cast("int"))
        return F.when(F.col("_user") < 0, from_core).otherwise(columns[name]).alias(name)

    generated = drawn.select(
        F.concat(F.lit("tx_"), (F.col(id_col) + 100000).cast("string")).alias("transaction_id"),
        copied("user_id"),
        choice(id_col, 22, [price for _, price in PRODUCTS]).alias("amount"),
        copied("credit_card"),
        choice(id_col, 22, [name for name, _ in PRODUCTS]).alias("product"),
        _time_before(id_col, 23, base).alias("date"),
        choice(id_col, 26, TRANSACTION_STATUSES).alias("status"),
    )
    core = ids.sparkSession.createDataFrame(CORE_TRANSACTIONS, TRANSACTIONS_SCHEMA)
    return core.unionByName(generated)


def gen_logs(ids: DataFrame, base: Column, id_col: str = "id") -> DataFrame:
    """The core log lines and one per id."""
    generated = ids.select(
        F.concat(F.lit("log_"), (F.col(id_col) + 100).cast("string")).alias("log_id"),
        choice(id_col, 31, LOG_LEVELS).alias("level"),
        choice(id_col, 32, LOG_MESSAGES).alias("message"),
        _time_before(id_col, 33, base).alias("timestamp"),
        F.concat(F.lit("192.168.1."), _number(id_col, 36, 2, 254)).alias("client_ip"),
    )
    core = ids.sparkSession.createDataFrame(CORE_LOGS, LOGS_SCHEMA)
    return core.unionByName(generated)
