"""Order-insensitive comparison of rows."""

from collections import Counter


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def spark_rows(df):
    return multiset(df.columns, df.collect())


def assert_same(left, right, label=""):
    if left != right:
        missing = list((right - left).items())[:3]
        extra = list((left - right).items())[:3]
        raise AssertionError(
            f"{label}: {sum(left.values())} rows against {sum(right.values())};"
            f" only left {extra}; only right {missing}"
        )
