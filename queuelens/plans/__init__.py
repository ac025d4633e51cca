"""Named reports and batch plans over the request table."""
