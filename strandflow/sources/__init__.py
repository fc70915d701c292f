"""Readers and writers of the domain's text formats, as DataFrames.

Records that span lines (FASTQ, FASTA) are parsed within one file by a Python stage over whole lines in file order;
files are the unit of parallelism, as their formats can't be split safely. Line formats go through Spark's own readers.
"""
