"""Named queries over the fixture tables, with the SQL that checks them."""
