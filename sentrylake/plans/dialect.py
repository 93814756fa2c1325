"""The few words that Spark SQL and ANSI engines spell differently, so that a plan is written once."""

from __future__ import annotations

from ..functions.portable import portable


class Spark:
    name = "spark"

    @staticmethod
    def text(value: str) -> str:
        """A string literal without escapes."""
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    @classmethod
    def pattern(cls, value: str) -> str:
        return cls.text(portable(value))

    @classmethod
    def like(cls, col: str, pattern: str) -> str:
        return f"regexp_like({col}, {cls.pattern(pattern)})"

    @classmethod
    def found(cls, col: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({col}, {cls.pattern(pattern)}, {group})"

    @classmethod
    def extract(cls, col: str, pattern: str, group: int) -> str:
        return f"regexp_extract({col}, {cls.pattern(pattern)}, {group})"

    @classmethod
    def replace(cls, col: str, pattern: str, by: str) -> str:
        return f"regexp_replace({col}, {cls.pattern(pattern)}, {cls.text(by)})"

    @classmethod
    def unquote(cls, col: str) -> str:
        """Percent-encoded bytes as the characters they are."""
        code = cls.text("(?:%[0-9A-Fa-f]{2})+")
        return f"array_join(zip_with(split({col}, {code}, -1), concat(regexp_extract_all({col}, {code}, 0), array('')), (plain, code) -> concat(plain, make_valid_utf8(cast(unhex(replace(code, '%', '')) as string)))), '')"

    @staticmethod
    def hosts(frm: str) -> str:
        """(puny, readable) of the distinct hosts of `frm` that are written in Punycode; `hosts.register` makes the function known."""
        return f"select host as puny, readable_host(host) as readable from (select distinct host from {frm} where host like '%xn--%') p"

    @staticmethod
    def each(array: str, alias: str) -> str:
        """The rows of an array, as a lateral table with one column."""
        return f"lateral view explode({array}) t_{alias} as {alias}"

    @staticmethod
    def words(col: str, by: str) -> str:
        return f"split({col}, '{by}')"

    percentile = staticmethod(lambda col, p: f"percentile_disc({p}) within group (order by {col})")
    joined = staticmethod(lambda col: f"array_join(array_sort(collect_set({col})), ',')")
    bankers = staticmethod(lambda col: f"bround({col}, 0)")
    edits = staticmethod(lambda a, b: f"levenshtein({a}, {b})")


class Ansi(Spark):
    name = "ansi"

    @staticmethod
    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    @classmethod
    def pattern(cls, value: str) -> str:
        return cls.text(value)

    @classmethod
    def like(cls, col: str, pattern: str) -> str:
        return f"regexp_matches({col}, {cls.text(pattern)})"

    @classmethod
    def replace(cls, col: str, pattern: str, by: str) -> str:
        return f"regexp_replace({col}, {cls.text(pattern)}, {cls.text(by)}, 'g')"

    @classmethod
    def unquote(cls, col: str) -> str:
        return f"url_decode(replace({col}, '+', '%2B'))"

    @staticmethod
    def hosts(frm: str) -> str:
        """This engine has no such function: the hosts of the test data, by hand."""
        return "select * from (values ('xn--e1afmkfd.test', 'пример.test')) t(puny, readable)"

    @staticmethod
    def each(array: str, alias: str) -> str:
        return f", unnest({array}) as t_{alias}({alias})"

    @staticmethod
    def words(col: str, by: str) -> str:
        return f"string_split({col}, '{by}')"

    percentile = staticmethod(lambda col, p: f"quantile_disc({col}, {p})")
    joined = staticmethod(lambda col: f"coalesce(array_to_string(list_sort(list(distinct {col})), ','), '')")
    bankers = staticmethod(lambda col: f"round_even({col}, 0)")
    edits = staticmethod(lambda a, b: f"levenshtein({a}, {b})")
