"""The models applied to a retail star schema: orders play the records, parts the works."""
