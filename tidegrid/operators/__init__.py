"""DataFrame operators over long series tables ``(series_id, ts, value, ...)``."""
