"""What is known about a table beforehand: keys, semantic types, dependencies, dictionaries, and fixed rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

ERROR, CLEAN, DOES_NOT_APPLY = 1, -1, 0

#: Semantic types of columns.
SEMANTIC_TYPES = (
    "String", "Integer", "Decimal", "Boolean", "Map", "Array", "IP Address", "URL", "HTTP Code", "Date/Time",
    "Social Security Number", "Phone Number", "Email Address", "Credit Card", "Gender", "Zip Code", "State", "Text",
)

#: Placeholders that stand for a missing value, by semantic type.
DEFAULT_VALUES = {
    "String": ("Not Available", "-", "--", "N/A", "unknown", "null", "Not provided by airline", "(none assigned)", "Dimensions unavailable"),
    "Integer": ("Not Available", "-", "--", "N/A", "unknown", "null", "NaN"),
    "Date/Time": ("Not Available", "-", "--", "N/A", "unknown", "null", "1970-01-01T00:00:00Z", "January 1st, 1900"),
}

#: Patterns of valid values; each must match as a whole.
NUMBER = r"(0|[1-9][0-9]*)(\.[0-9]+)?|\.[0-9]+"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
ZIP = (r"[0-9]{5}|[0-9]{9}", r"[0-9]{5}-[0-9]{4}")
STATE_CODES = (
    "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy pr dc vi"
).split()
STATE_NAMES = (
    "alabama|alaska|arizona|arkansas|california|colorado|connecticut|delaware|florida|georgia|hawaii|idaho|illinois|indiana|iowa|kansas|kentucky|louisiana|maine|"
    "maryland|massachusetts|michigan|minnesota|mississippi|missouri|montana|nebraska|nevada|new hampshire|new jersey|new mexico|new york|north carolina|"
    "north dakota|ohio|oklahoma|oregon|pennsylvania|rhode island|south carolina|south dakota|tennessee|texas|utah|vermont|virginia|washington|west virginia|"
    "wisconsin|wyoming|puerto rico|district of columbia|virgin islands"
).split("|")
GENDER = r"m(?:ale)?|f(?:emale)?"
EMAIL = r"[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9.-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}"
CREDIT_CARDS = (
    r"4\d{3}[ -]?(\d{4}[ -]?){3}",
    r"5[1-5]\d{2}[ -]?(\d{4}[ -]?){3}",
    r"3[4,7]\d{2}[ -]?\d{6}[ -]?\d{5}",
    r"6(011|(5\d{2}))[ -]?(\d{4}[ -]?){3}",
    r"((35\d{2}[ -]?(\d{4}[ -]?){3})|((1800|2131)[ -]?(\d{4}[ -]?){2}\d{3}))",
    r"3((0[0-5]\d{1})|([6,8]\d{2}))[ -]?\d{6}[ -]?\d{5}",
)


@dataclass(frozen=True)
class FD:
    """A functional dependency. Its first right-hand attribute is the one that is checked."""

    lhs: tuple[str, ...]
    rhs: tuple[str, ...]

    @property
    def attributes(self) -> tuple[str, ...]:
        return self.lhs + self.rhs

    def __str__(self) -> str:
        return f"{', '.join(self.lhs)} -> {', '.join(self.rhs)}"


@dataclass(frozen=True)
class TableSpec:
    """Names are checked against the table when it is used; an unknown one is an error, not a rule that never fires."""

    record_id: str
    columns: tuple[str, ...]
    semantic_types: dict[str, str] = field(default_factory=dict)
    fds: tuple[FD, ...] = ()
    unique_columns: tuple[str, ...] = ()

    def type_of(self, attribute: str) -> str:
        return self.semantic_types.get(attribute, "String")

    def check(self, df: DataFrame) -> TableSpec:
        known = set(df.columns)
        named = {self.record_id, *self.columns, *self.semantic_types, *self.unique_columns, *(a for fd in self.fds for a in fd.attributes)}
        if missing := sorted(named - known):
            raise ValueError(f"columns not in the table: {missing}")
        return self
