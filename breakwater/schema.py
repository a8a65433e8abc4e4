"""Schemas of the engine's tables, as Spark DDL. Positions are 0-based, stop is exclusive."""

from __future__ import annotations

CONTIGS = "ord INT, chrom STRING, length BIGINT"
ALIGNMENTS = "ord BIGINT, read_name STRING, flag INT, chrom STRING, start BIGINT, stop BIGINT, mapq INT, cigar STRING, sa STRING, query_length INT"
REPEATS = "chrom STRING, start BIGINT, stop BIGINT, info STRING"
CHUNKS = "chrom STRING, chunk_start BIGINT, seq STRING"
EVIDENCE = "ev_type STRING, sv_type STRING, chrom STRING, start BIGINT, stop BIGINT, size BIGINT, read_name STRING, mapq INT, interspersed BOOLEAN, chr2 STRING, pos2 BIGINT, bnd_type STRING, components ARRAY<STRING>, ord BIGINT, step INT"
EVIDENCE_NAMES = [x.split()[0] for x in EVIDENCE.split(", ")]
