"""Operators of a training-data pipeline.

Each module holds one operator as ``DataFrame -> DataFrame`` functions;
``queries`` registers one query per operator over the driver's tables and
``oracle`` the DuckDB SQL of those that SQL can express.  Nothing outside
this subpackage imports it.
"""
