"""Operations of a training-data pipeline. Nothing outside this subpackage imports it.

Every operator takes a DataFrame and column names, reads only the named columns (others may have
any names) and writes intermediate tables to the shared folder of ``tables.py``.
"""
