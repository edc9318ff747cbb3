"""Registered queries with the SQL that an independent engine must agree with."""
