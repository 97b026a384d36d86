"""Row operators: filters, de-duplication, measures, joins and unions."""
