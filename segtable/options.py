"""Every tunable of a table."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from .errors import InvalidArgument

#: Values that must equal the documented format: bounds of a row group's rows and the parts a flush aims at.
ROW_GROUP_ROWS, MIN_ROW_GROUP_ROWS, PARTS = 131072, 8192, 8
CODECS = {"none": "none", "auto": "lz4_raw", "lz4": "lz4_raw", "zstd": "zstd", "snappy": "snappy"}

DURABILITY = ("none", "os", "full")


@dataclass(frozen=True)
class TableOptions:
    """What shapes a segment counts when the segment is written; reopening changes nothing that exists.

    ``durability`` says how a commit reaches the disk: "none" (not synced), "os" (synced) or
    "full" (synced, read back and compared). ``verify_checksums`` has readers check the checksum
    of every Parquet page. ``bloom_columns`` and ``trigram_columns`` name the filtered columns; ("*",) means all.
    """

    staged_max_bytes: int = 64 << 20
    staged_max_files: int = 256
    row_group_rows: int = ROW_GROUP_ROWS
    min_row_group_rows: int = MIN_ROW_GROUP_ROWS
    compression: str = "none"
    dictionary_encoding: bool = True
    cluster_by: tuple[str, ...] = ()
    page_rows: int = 8192
    compaction_max_bytes: int = 256 << 20
    bloom_columns: tuple[str, ...] = ()
    trigram_columns: tuple[str, ...] = ()
    bloom_bits_per_value: int = 10
    durability: str = "os"
    verify_checksums: bool = True
    read_only: bool = False

    def __post_init__(self):
        if self.compression not in CODECS:
            raise InvalidArgument(f"unknown compression {self.compression!r}")
        if self.durability not in DURABILITY:
            raise InvalidArgument(f"unknown durability {self.durability!r}")
        if self.row_group_rows < 0 or self.min_row_group_rows < 0 or self.bloom_bits_per_value < 1:
            raise InvalidArgument("sizes must not be negative")

    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, x: dict) -> TableOptions:
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items() if k in known})

    def group_rows(self, total: int) -> int:
        """Rows of a segment when ``total`` rows are written: an eighth, within bounds; 0 bounds mean one segment."""
        if self.row_group_rows == 0:
            return max(total, 1)
        return max(min(self.min_row_group_rows, self.row_group_rows), min(self.row_group_rows, -(-total // PARTS)), 1)

    def parquet(self, columns: list[str], bloom: list[str], rows: int) -> dict[str, str]:
        """Writer options: codec, dictionary, page rows, and Parquet's own membership filters."""
        out = {"compression": CODECS[self.compression], "parquet.enable.dictionary": str(self.dictionary_encoding).lower()}
        if self.page_rows:
            out["parquet.page.row.count.limit"] = str(self.page_rows)
        for c in bloom:
            out |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.expected.ndv#{c}": str(max(rows, 1))}
        return out
