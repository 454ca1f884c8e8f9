"""glossaudit: language-markup audits of web pages as Spark jobs (WCAG 2.1, SC 3.1.1 and 3.1.2)."""

from glossaudit.params import AuditParams

__all__ = ["AuditParams"]
