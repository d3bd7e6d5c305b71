"""Sample views and the registered queries over them."""
