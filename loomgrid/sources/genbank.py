"""GenBank flat files as a Spark data source (format ``loomgrid_genbank``): a row for each coding sequence.

Options: path (a file, folder or glob that pyarrow.fs can list), translate
(``true``: translate where a record has no translation), decode (``true``:
URL-decode names and drop those with a reserved prefix), one partition a file.
"""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import _codon_table

SCHEMA = "strain string, gene string, locus_tag string, product string, start long, end long, strand int, translation string"
RESERVED = ("BSU", "CUSTOM_")
_QUALIFIER = re.compile(r'^/(\w+)(?:=(.*))?$', re.S)
_SPAN = re.compile(r"<?(\d+)(?:\.\.>?(\d+))?")
_NAME = re.compile(r"\[gene(?:=|%3D)([^\]]+)\]")


@dataclass
class File(InputPartition):
    path: str


def strain_of(path: str) -> str:
    """File name without extension and edit mark."""
    return re.sub(r"(_edit(ed|2)?)?\.(gbk|gbff|gb)$", "", path.rsplit("/", 1)[-1])


def translated(dna: str) -> str:
    table = _codon_table()
    return "".join(table.get(dna[i : i + 3].upper(), "X") for i in range(0, len(dna) - 2, 3)).rstrip("*")


def records(text: str):
    """(features, sequence) of each record; a feature is (kind, location, qualifiers)."""
    for record in text.split("\n//"):
        if "FEATURES" not in record:
            continue
        body, _, origin = record.partition("\nORIGIN")
        features: list[list] = []
        for line in body.partition("FEATURES")[2].split("\n")[1:]:
            if line[:5].strip() == "" and line[5:6].strip():
                kind, _, location = line.strip().partition(" ")
                features.append([kind, location.strip(), []])
            elif features and line.startswith(" " * 21):
                part = line[21:].rstrip()
                if part.startswith("/"):
                    features[-1][2].append(part)
                elif features[-1][2]:
                    features[-1][2][-1] += ("" if features[-1][2][-1].startswith("/translation") else " ") + part
                else:
                    features[-1][1] += part
        yield features, re.sub(r"[^A-Za-z]", "", origin)


def coding_sequences(text: str, strain: str, translate: bool = False, decode: bool = False):
    seen = set()
    for features, dna in records(text):
        for kind, location, raw in features:
            if kind != "CDS":
                continue
            q = {}
            for part in raw:
                m = _QUALIFIER.match(part)
                if m:
                    q.setdefault(m[1], (m[2] or "").strip('"'))
            spans = [(int(a), int(b or a)) for a, b in _SPAN.findall(location)]
            if not spans:
                continue
            start, end, strand = spans[0][0], spans[-1][1], -1 if "complement" in location else 1
            gene = q.get("gene")
            if not gene and (m := _NAME.search(q.get("product", ""))):
                gene = m[1]
            if decode and gene:
                gene = unquote(gene)
            if decode and gene and gene.startswith(RESERVED):
                gene = None
            protein = q.get("translation")
            if protein is None and translate and dna:
                part = "".join(dna[a - 1 : b] for a, b in spans)
                protein = translated(part if strand > 0 else part.upper()[::-1].translate(str.maketrans("ACGT", "TGCA")))
            if not protein or (not decode and "locus_tag" not in q):
                continue
            key = (gene, start, end, strand)
            if decode and key in seen:
                continue
            seen.add(key)
            yield strain, gene, q.get("locus_tag"), q.get("product"), start, end, strand, protein


class GenBankReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.translate, self.decode = (str(options.get(k, "false")).lower() == "true" for k in ("translate", "decode"))

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if ":/" in self.path else (pafs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        fs, path = self._fs()
        base, pattern = (path.rsplit("/", 1) if re.search(r"[*?\[]", path) else (path, "*"))
        info = fs.get_file_info(base)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(base, recursive=True))
        return [File(f.path) for f in sorted(files, key=lambda f: f.path) if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and re.search(r"\.(gbk|gbff|gb)$", f.base_name)] or [File("")]

    def read(self, partition: File):
        if partition.path:
            with self._fs()[0].open_input_stream(partition.path) as f:
                text = f.read().decode("utf-8", "replace").replace("\r\n", "\n")
            yield from coding_sequences(text, strain_of(partition.path), self.translate, self.decode)


class GenBankSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomgrid_genbank"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GenBankReader(dict(self.options))


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(GenBankSource)
    return spark.read.format("loomgrid_genbank").options(**options).load(path)
