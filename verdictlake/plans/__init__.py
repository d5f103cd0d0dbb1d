"""Tables derived from the driver's inputs, and the registered queries over them."""
