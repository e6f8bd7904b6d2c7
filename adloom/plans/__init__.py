"""Operators put together: the registered queries with their reference SQL, and the daily warehouse build."""
